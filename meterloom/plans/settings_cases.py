"""Queries over changes of settings: a project for each customer, whose two snapshots are one of a list of cases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.plans.registry import query, table
from meterloom.plans.settings_diff import RULES, at_pointer, changes, is_read, leaves, verdict


def _permissions(**lists) -> dict:
    return {"permissions": lists}


def _hook(*commands: str, **more) -> dict:
    return {"hooks": {"Stop": [{"matcher": "x", "hooks": [{"type": "command", "command": c, **more} for c in commands]}]}}


def _server(**fields) -> dict:
    return {"mcpServers": {"s@": fields}}


#: What a snapshot holds before and after, and the changes that are to be told: kind, key, change, rule, breadth, flags
#: (by commas), category, what is unread; @ is the customer's number, and what follows # is told by its digest.
#: Direction and tier are those of the rule's row, unless a case gives its own.
CASES: list[tuple] = [
    (_permissions(allow=["Bash(ls:*)"]), _permissions(allow=["Bash(ls *)"]), []),
    ({}, _permissions(allow=["Bash(make t@)"]), [("perm", "perm:allow:Bash(make t@)", "added", "D-allow-added", "exact", "", "scoped-allow", "")]),
    ({}, _permissions(allow=["Read"]), [("perm", "perm:allow:Read", "added", "D-allow-added", "whole_tool", "", "whole-tool-allow", "")]),
    (_permissions(allow=["Bash(npm run *)"]), {}, [("perm", "perm:allow:Bash(npm run *)", "removed", "D-allow-removed", "prefix", "", None, "")]),
    ({}, _permissions(allow=["Bash(git * main@)"]), [("perm", "perm:allow:Bash(git * main@)", "added", "D-allow-added", "glob", "breadth_unresolved,broad", "scoped-allow", "")]),
    (_permissions(deny=["Edit"]), _permissions(allow=["Edit"], deny=["Edit"]), [("perm", "perm:allow:Edit", "added", "D-allow-added", "whole_tool", "shadowed", None, "", "neutral", "projected")]),
    ({}, _permissions(allow=["Glob(src/**)"]), [("perm", "perm:allow:Glob(src/**)", "added", "D-allow-added", "unknown", "ignored", None, "", "neutral", "proven")]),
    ({}, _permissions(ask=["Bash(rm t@)"]), [("perm", "perm:ask:Bash(rm t@)", "added", "D-ask-added", "exact", "", None, "")]),
    (_permissions(ask=["WebFetch"]), {}, [("perm", "perm:ask:WebFetch", "removed", "D-ask-removed", "whole_tool", "", None, "")]),
    ({}, _permissions(deny=["WebFetch"]), [("perm", "perm:deny:WebFetch", "added", "D-deny-added", "whole_tool", "", None, "")]),
    (_permissions(deny=["Bash(push t@)"]), {}, [("perm", "perm:deny:Bash(push t@)", "removed", "D-deny-removed", "exact", "", "deny-removed", "")]),
    ({}, _permissions(allow=["Bash(sudo a && b > c)"]), [("perm", "perm:allow:Bash(sudo a && b > c)", "added", "D-allow-added", "exact", "", "scoped-allow", "N-compound-command,N-wrapper-stripping,N-redirect", "widens", "unresolved")]),
    ({}, _permissions(allow=["Bash(A=@ run)"]), [("perm", "perm:allow:Bash(A=@ run)", "added", "D-allow-added", "exact", "", "scoped-allow", "N-env-assignment", "widens", "unresolved")]),
    ({}, _permissions(deny=["Read(~/t@/**)"]), [("perm", "perm:deny:Read(~/t@/**)", "added", "D-deny-added", "unknown", "", None, "N-path-anchoring,N-depth-semantics,N-symlink-pairing", "narrows", "unresolved")]),
    (_hook("run@"), _hook("run@", "more@"), [("hook", "hook:Stop:x:#more@", "added", "D-hook-added", None, "", "hook", "")]),
    (_hook("run@"), {}, [("hook", "hook:Stop:x:#run@", "removed", "D-hook-removed", None, "", None, "")]),
    (_hook("run@"), _hook("other@"), [("hook", "hook:Stop:x:#other@", "changed", "D-hook-changed", None, "", "hook", "")]),
    (_hook("run@"), _hook("run@", timeout=5), [("hook", "hook:Stop:x:#run@", "changed", "D-hook-attrs-changed", None, "", None, "")]),
    ({}, _server(command="srv"), [("mcp", "mcp:s@", "added", "D-mcp-added", None, "", "mcp", "")]),
    ({}, _server(url="http://h@.example.org/"), [("mcp", "mcp:s@", "added", "D-mcp-added", None, "plaintext", "mcp", "")]),
    ({}, _server(url="https://${HOST}/"), [("mcp", "mcp:s@", "added", "D-mcp-added", None, "variable_reference", "mcp", "", "widens", "unresolved")]),
    (_server(command="srv"), {}, [("mcp", "mcp:s@", "removed", "D-mcp-removed", None, "", None, "")]),
    (_server(command="srv"), _server(command="srv", args=["-v"]), [("mcp", "mcp:s@", "changed", "D-mcp-changed", None, "", "mcp", "")]),
    (_server(command="srv", env={"A": "1"}), _server(command="srv", env={"A": "1", "B": "2"}), [("mcp", "mcp:s@", "changed", "D-mcp-attrs-changed", None, "", None, "")]),
    (_server(url="https://a", headers={"x": "1"}), _server(url="https://a", headers={"x": "2"}), [("mcp", "mcp:s@", "changed", "D-env-value-changed", None, "", None, "")]),
    ({}, {"env": {"PATH": "/b@"}}, [("env_key", "env_key:PATH", "added", "D-env-sensitive-set", None, "", "env", "")]),
    ({"env": {"COLOR": "red"}}, {"env": {"COLOR": "t@"}}, [("env_key", "env_key:COLOR", "changed", "D-env-value-changed", None, "", None, "")]),
    ({"env": {"OLD": "1"}}, {}, [("env_key", "env_key:OLD", "removed", "D-unknown", None, "", None, "")]),
    ({}, {"enableAllProjectMcpServers": True}, [("plugin_flag", "plugin_flag:enableAllProjectMcpServers", "added", "D-enable-all-mcp", None, "", "mcp", "")]),
    ({"enableAllProjectMcpServers": True}, {}, [("plugin_flag", "plugin_flag:enableAllProjectMcpServers", "removed", "D-enable-all-mcp-off", None, "", None, "")]),
    ({}, {"disableAllHooks": True}, [("plugin_flag", "plugin_flag:disableAllHooks", "added", "D-hooks-disabled", None, "", None, "")]),
    ({"disableAllHooks": True}, {"disableAllHooks": False}, [("plugin_flag", "plugin_flag:disableAllHooks", "changed", "D-hooks-reenabled", None, "", "hooks-reenabled", "")]),
    ({}, {"disableAllHooks": False}, [("plugin_flag", "plugin_flag:disableAllHooks", "added", "D-flag-default", None, "", None, "")]),
    ({}, {"enabledPlugins": {"p@": True}}, [("plugin_flag", "plugin_flag:enabledPlugins", "added", "D-unknown", None, "", None, "N-plugin-provided")]),
    (_permissions(defaultMode="plan"), _permissions(defaultMode="auto"), [("mode", "mode:defaultMode", "changed", "D-mode-widened", None, "", "mode", "")]),
    (_permissions(defaultMode="auto"), {}, [("mode", "mode:defaultMode", "removed", "D-mode-narrowed", None, "", None, "")]),
    (_permissions(defaultMode="plan"), _permissions(defaultMode="default"), [("mode", "mode:defaultMode", "changed", "D-mode-neutral", None, "", None, "")]),
    ({}, _permissions(defaultMode="own@"), [("mode", "mode:defaultMode", "added", "D-mode-unknown", None, "", None, "")]),
    ({}, _permissions(additionalDirectories=["/d@"]), [("dir", "dir:/d@", "added", "D-dir-added", None, "", "directory", "")]),
    (_permissions(additionalDirectories=["/d@"]), {}, [("dir", "dir:/d@", "removed", "D-dir-removed", None, "", None, "")]),
    ((_permissions(deny=["Edit"]), "a"), (_permissions(deny=["Edit"]), "b"), [("perm", "perm:deny:Edit", "moved", "D-moved", "whole_tool", "", None, "")]),
    ({}, "{@", [("unreadable", "f@", "added", "D-unknown", None, "", None, "")]),
]


def _files(spark, sf_dir, side: int) -> DataFrame:
    """customer, path and content of each customer's snapshot."""
    shown = [case[side] if isinstance(case[side], tuple) else (case[side], "f") for case in CASES]
    texts = F.array(*[F.lit(text if isinstance(text, str) else json.dumps(text)) for text, _ in shown])
    paths = F.array(*[F.lit(path) for _, path in shown])
    key = F.col("c_custkey")
    at, number = (key % len(CASES)).cast("int"), key.cast("string")
    own = lambda c: F.replace(F.get(c, at), F.lit("@"), number)
    return table(spark, sf_dir, "customer").select(key.alias("customer"), F.concat(F.get(paths, at), number).alias("path"), own(texts).alias("content"))


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _expected() -> str:
    rows = []
    for i, (_, _, found) in enumerate(CASES):
        for kind, key, change, rule, breadth, flags, category, unread, *own in found:
            direction, tier = own or RULES[rule]
            rows.append("(" + ", ".join(map(_literal, (i, kind, key, change, rule, direction, tier, breadth, flags, category, unread))) + ")")
    return f"""v(i, kind, key, change, rule, direction, tier, breadth, flags, category, unread) AS (VALUES {', '.join(rows)}),
    w AS (SELECT c_custkey AS customer, kind, replace(CASE WHEN contains(key, '#') THEN split_part(key, '#', 1) ELSE key END, '@', CAST(c_custkey AS VARCHAR)) || CASE WHEN contains(key, '#') THEN sha256(replace(split_part(key, '#', 2), '@', CAST(c_custkey AS VARCHAR))) ELSE '' END AS key,
        change, rule, direction, tier, breadth, flags, category, unread FROM customer JOIN v ON v.i = c_custkey % {len(CASES)})"""


@query(f"WITH {_expected()} SELECT * FROM w")
def settings_changes(spark, sf_dir):
    """What changed between two snapshots of every customer's settings, each rule of the table among them."""
    found = changes(_files(spark, sf_dir, 0), _files(spark, sf_dir, 1), ["customer"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("flags", "unread")})


@query(f"""WITH {_expected()}, s AS (SELECT c_custkey AS customer, count(w.key) FILTER (WHERE kind <> 'unreadable' AND direction = 'widens') AS widens, count(w.key) FILTER (WHERE kind <> 'unreadable' AND direction = 'narrows') AS narrows, count(w.key) FILTER (WHERE kind <> 'unreadable' AND direction = 'neutral') AS neutral, count(w.key) FILTER (WHERE kind <> 'unreadable' AND direction = 'unknown') AS unknown, count(w.key) FILTER (WHERE kind = 'unreadable') AS unreadable,
        count(w.key) FILTER (WHERE direction = 'widens' AND tier = 'proven' AND category <> 'scoped-allow') AS failing, count(w.key) FILTER (WHERE kind <> 'unreadable' AND (tier <> 'proven' OR contains(flags, 'breadth_unresolved'))) AS undecided, count(w.key) AS n FROM customer LEFT JOIN w ON w.customer = c_custkey GROUP BY c_custkey)
    SELECT * EXCLUDE (n), CASE WHEN unreadable > 0 THEN 'incomplete' WHEN failing > 0 THEN 'expands' WHEN undecided > 0 THEN 'undecided' WHEN n = 0 THEN 'no-change' ELSE 'pass' END AS verdict, CASE WHEN unreadable > 0 THEN 3 WHEN failing > 0 THEN 1 WHEN undecided > 0 THEN 2 ELSE 0 END AS exit_code FROM s""")
def settings_verdicts(spark, sf_dir):
    """The verdict on every customer's change of settings."""
    base, head = _files(spark, sf_dir, 0), _files(spark, sf_dir, 1)
    return verdict(changes(base, head, ["customer"]), keys=["customer"], among=base)


@query("""SELECT c_custkey AS customer, unnest(['/env/A~1' || c_custkey % 9, '/nested/0/deep~0er/' || (c_custkey % 3), '/nested/1', '/permissions/allow/0', '/permissions/other']) AS pointer, unnest([CAST(to_json(c_name) AS VARCHAR), CAST(c_custkey AS VARCHAR), '{}', '"Read"', 'null']) AS leaf, unnest([true, false, false, true, false]) AS read, unnest([true, true, true, true, true]) AS found FROM customer""")
def settings_leaves(spark, sf_dir):
    """Every value of a settings file by its pointer, whether it is read, and whether its pointer leads to it."""
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    names = F.to_json(F.create_map(F.concat(F.lit("A/"), text(key % 9)), F.col("c_name")))
    deep = F.concat(F.lit('{"deep~er":['), F.when(key % 3 == 0, text(key)).when(key % 3 == 1, F.concat(F.lit("[],"), text(key))).otherwise(F.concat(F.lit("[],[],"), text(key))), F.lit("]}"))
    content = F.concat(F.lit('{"permissions":{"allow":["Read"],"other":null},"env":'), names, F.lit(',"nested":['), deep, F.lit(",{}]}"))
    files = table(spark, sf_dir, "customer").select(key.alias("customer"), content.alias("content"), content.alias("whole"))
    found = leaves(files).where(~F.col("pointer").rlike("^/nested/0/") | (F.col("leaf") != "[]"))
    return found.select("customer", "pointer", "leaf", is_read(F.col("pointer")).alias("read"), at_pointer(F.col("whole"), F.col("pointer")).eqNullSafe(F.col("leaf")).alias("found"))
