"""What two snapshots of tool settings allow: entries, their changes, the direction of each, and a verdict.

Values are compared by digests and never carried. What is documented is proven, what follows from it by
inference projected, and what nothing tells unresolved: a change of that kind never counts as harmless."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators.components import checkpointed
from meterloom.operators.joins import null_safe_join
from meterloom.plans.registry import query, table

_HOOK = "array<struct<matcher:string,hooks:array<struct<type:string,command:string,timeout:bigint>>>>"
_SERVER = "struct<command:string,args:array<string>,url:string,type:string,env:map<string,string>,headers:map<string,string>>"
SETTINGS = f"permissions struct<allow:array<string>,ask:array<string>,deny:array<string>,defaultMode:string,additionalDirectories:array<string>>, env map<string,string>, hooks map<string,{_HOOK}>, mcpServers map<string,{_SERVER}>, enableAllProjectMcpServers boolean, disableAllHooks boolean, enabledPlugins variant"
#: Modes that let an agent go on without asking and those that don't; tools whose rules with a path
#: nothing evaluates; names of variables that redirect traffic or load code.
WIDENING, PLAIN = ("bypassPermissions", "auto", "dontAsk"), ("acceptEdits", "plan", "default")
IGNORED_TOOLS, PATH_TOOLS = ("Write", "NotebookEdit", "Glob", "MultiEdit"), ("Read", "Edit")
SENSITIVE = ("ANTHROPIC_BASE_URL", "ANTHROPIC_AUTH_TOKEN", "HTTP_PROXY", "HTTPS_PROXY", "ALL_PROXY", "NO_PROXY", "NODE_OPTIONS", "NODE_EXTRA_CA_CERTS", "SSL_CERT_FILE", "PATH", "LD_PRELOAD")
SENSITIVE_BEGINNINGS = ("CLAUDE_CODE_", "DYLD_")
FAILING = ("hook", "mcp", "mode", "whole-tool-allow", "directory", "hooks-reenabled", "deny-removed", "env")
#: Direction and tier of each rule of the table, and the category of each that widens.
RULES = {
    "D-allow-added": ("widens", "proven"),
    "D-ask-added": ("neutral", "proven"),
    "D-deny-added": ("narrows", "proven"),
    "D-allow-removed": ("narrows", "proven"),
    "D-ask-removed": ("neutral", "proven"),
    "D-deny-removed": ("widens", "proven"),
    "D-hook-added": ("widens", "proven"),
    "D-hook-removed": ("narrows", "proven"),
    "D-hook-changed": ("widens", "proven"),
    "D-hook-attrs-changed": ("neutral", "proven"),
    "D-mcp-added": ("widens", "proven"),
    "D-mcp-removed": ("narrows", "proven"),
    "D-mcp-changed": ("widens", "proven"),
    "D-mcp-attrs-changed": ("unknown", "unresolved"),
    "D-env-sensitive-set": ("widens", "proven"),
    "D-env-value-changed": ("unknown", "unresolved"),
    "D-enable-all-mcp": ("widens", "proven"),
    "D-enable-all-mcp-off": ("narrows", "proven"),
    "D-mode-widened": ("widens", "proven"),
    "D-mode-narrowed": ("narrows", "proven"),
    "D-mode-neutral": ("neutral", "proven"),
    "D-mode-unknown": ("unknown", "unresolved"),
    "D-hooks-disabled": ("narrows", "proven"),
    "D-hooks-reenabled": ("widens", "proven"),
    "D-dir-added": ("widens", "proven"),
    "D-dir-removed": ("narrows", "proven"),
    "D-flag-default": ("neutral", "proven"),
    "D-moved": ("neutral", "proven"),
    "D-unknown": ("unknown", "unresolved"),
}
CATEGORIES = {"D-deny-removed": "deny-removed", "D-hook-added": "hook", "D-hook-changed": "hook", "D-mcp-added": "mcp", "D-mcp-changed": "mcp", "D-enable-all-mcp": "mcp", "D-mode-widened": "mode", "D-dir-added": "directory", "D-hooks-reenabled": "hooks-reenabled", "D-env-sensitive-set": "env"}


def normal_rule(rule: Column) -> Column:
    """Tool(spec) with blanks trimmed and `:*` as ` *`; a bare tool and Tool(*) stay two spellings."""
    whole = F.trim(rule)
    tool, spec = F.trim(F.regexp_extract(whole, r"(?s)^([^(]+)\((.*)\)$", 1)), F.trim(F.regexp_extract(whole, r"(?s)^([^(]+)\((.*)\)$", 2))
    prefix = F.rtrim(F.regexp_replace(spec, r"(?:\s+|:)\*$", ""))
    normal = F.when(spec == "*", "*").when(spec.rlike(r"(?:\s|:)\*$"), F.when(prefix == "", "*").otherwise(F.concat(prefix, F.lit(" *")))).otherwise(spec)
    return F.when(whole.rlike(r"(?s)^[^(]+\(.*\)$"), F.concat(tool, F.lit("("), normal, F.lit(")"))).otherwise(whole)


def digests(values: Column) -> Column:
    """Of a map of values a map of their digests: nothing of a value stays but its length and hash."""
    return F.transform_values(values, lambda _, v: F.concat_ws(":", F.length(v).cast("string"), F.sha2(v, 256)))


def entries(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, path, kind, key and value of each entry of files (keys, path, content): permission rules, the mode, directories,
    hooks, servers, variables and flags. value is text that tells two entries of a key apart. A file that is no
    JSON object gives one entry of kind `unreadable`. Comments are allowed; of a key that stands twice the last
    counts."""
    held = files.withColumn("j", F.from_json("content", f"{SETTINGS}, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowComments": "true"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    good = held.where(~bad).select(*keys, "path", "j.*")
    found = held.where(bad).select(*keys, "path", F.lit("unreadable").alias("kind"), F.col("path").alias("key"), F.sha2("content", 256).alias("value"))

    def add(rows: DataFrame, kind: str, key: Column, value: Column) -> None:
        nonlocal found
        found = found.unionByName(rows.select(*keys, "path", F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), key).alias("key"), F.coalesce(value, F.lit("")).alias("value")))

    for kind in ("allow", "ask", "deny"):
        add(good.select(*keys, "path", F.explode(f"permissions.{kind}").alias("rule")), "perm", F.concat(F.lit(f"{kind}:"), normal_rule(F.col("rule"))), F.lit(""))
    add(good.where("permissions.defaultMode IS NOT NULL"), "mode", F.lit("defaultMode"), F.col("permissions.defaultMode"))
    add(good.select(*keys, "path", F.explode("permissions.additionalDirectories").alias("dir")), "dir", F.col("dir"), F.lit(""))
    add(good.select(*keys, "path", F.explode(digests(F.col("env"))).alias("name", "digest")), "env_key", F.col("name"), F.col("digest"))
    for flag in ("enableAllProjectMcpServers", "disableAllHooks"):
        add(good.where(F.col(flag).isNotNull()), "plugin_flag", F.lit(flag), F.col(flag).cast("string"))
    add(good.where("enabledPlugins IS NOT NULL"), "plugin_flag", F.lit("enabledPlugins"), F.to_json("enabledPlugins"))
    events = good.select(*keys, "path", F.explode("hooks").alias("event", "groups")).select(*keys, "path", "event", F.explode("groups").alias("g")).select(*keys, "path", "event", F.coalesce("g.matcher", F.lit("")).alias("matcher"), F.explode("g.hooks").alias("h"))
    add(events, "hook", F.concat_ws(":", "event", "matcher", F.sha2(F.coalesce("h.command", F.lit("")), 256)), F.concat_ws("|", "h.type", F.col("h.timeout").cast("string")))
    servers = good.select(*keys, "path", F.explode("mcpServers").alias("name", "s"))
    add(servers, "mcp", F.col("name"), F.to_json(F.struct("s.command", "s.args", "s.url", "s.type", digests(F.col("s.env")).alias("env"), digests(F.col("s.headers")).alias("headers"))))
    return found.distinct()


def sensitive(name: Column) -> Column:
    upper = F.upper(name)
    found = upper.isin(*SENSITIVE)
    for beginning in SENSITIVE_BEGINNINGS:
        found = found | F.startswith(upper, F.lit(beginning))
    return found


def _server_rule() -> Column:
    """How a server that stands on both sides changed, by fields and by digests of its values."""
    read = lambda side: F.from_json(side, "command string, args array<string>, url string, type string, env map<string,string>, headers map<string,string>")
    b, h = read(F.col("b_value")), read(F.col("h_value"))
    transport = F.lit(False)
    for c in ("command", "args", "url", "type"):
        transport = transport | ~b[c].eqNullSafe(h[c])
    empty = F.create_map().cast("map<string,string>")
    before = lambda m, k: F.try_element_at(F.coalesce(b[m], empty), k)
    names = lambda m: F.map_keys(F.coalesce(h[m], empty))
    of = lambda m, k: F.try_element_at(F.coalesce(h[m], empty), k)
    risky = F.exists(names("env"), lambda k: sensitive(k) & ~before("env", k).eqNullSafe(of("env", k)))
    other = lambda m: F.exists(names(m), lambda k: before(m, k).isNotNull() & (before(m, k) != of(m, k)))
    return F.when(transport, "D-mcp-changed").when(risky, "D-env-sensitive-set").when(other("env") | other("headers"), "D-env-value-changed").otherwise("D-mcp-attrs-changed")


def _direction_rule() -> Column:
    kind, key, change, b, h = (F.col(c) for c in ("kind", "key", "change", "b_value", "h_value"))
    by = lambda table: F.coalesce(*[F.when(change == k, v) for k, v in table.items()])
    of_list = F.regexp_extract(key, "^perm:([a-z]+):", 1)
    mode = lambda v: F.when(v.isNull(), "absent").when(v.isin(*WIDENING), "widening").when(v.isin(*PLAIN), "plain").otherwise("unknown")
    mode_rule = F.when((mode(b) == "unknown") | (mode(h) == "unknown"), "D-mode-unknown").when((mode(h) == "widening") & (mode(b) != "widening"), "D-mode-widened").when((mode(b) == "widening") & (mode(h) != "widening"), "D-mode-narrowed").otherwise("D-mode-neutral")

    def flag(on: str, off: str) -> Column:
        return F.when(change == "added", F.when(h == "true", on).otherwise("D-flag-default")).when(change == "removed", F.when(b == "true", off).otherwise("D-flag-default")).otherwise(F.when(h == "true", on).otherwise(off))

    risky = sensitive(F.substring(key, F.lit(9), F.length(key)))
    return (
        F.when(change == "moved", "D-moved")
        .when(kind == "perm", F.concat(F.lit("D-"), of_list, F.lit("-"), change))
        .when(kind == "hook", F.coalesce(by({"added": "D-hook-added", "removed": "D-hook-removed"}), F.when(F.col("paired"), "D-hook-changed").otherwise("D-hook-attrs-changed")))
        .when(kind == "mcp", F.coalesce(by({"added": "D-mcp-added", "removed": "D-mcp-removed"}), _server_rule()))
        .when(kind == "env_key", F.when(change == "removed", "D-unknown").when(risky, "D-env-sensitive-set").when(change == "changed", "D-env-value-changed").otherwise("D-unknown"))
        .when(kind == "dir", F.coalesce(by({"added": "D-dir-added", "removed": "D-dir-removed"}), F.lit("D-moved")))
        .when(kind == "mode", mode_rule)
        .when(key == "plugin_flag:enableAllProjectMcpServers", flag("D-enable-all-mcp", "D-enable-all-mcp-off"))
        .when(key == "plugin_flag:disableAllHooks", flag("D-hooks-disabled", "D-hooks-reenabled"))
        .otherwise("D-unknown")
    )


def paired_hooks(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One hook that went and one that came, of the same event, matcher and file, as one whose command changed."""
    marked = found.withColumn("prefix", F.when((F.col("kind") == "hook") & F.col("change").isin("added", "removed"), F.regexp_replace("key", ":[^:]*$", ":")))
    hooks = marked.where("prefix IS NOT NULL").withColumn("path", F.coalesce("h_path", "b_path"))
    of = lambda change, c: F.max(F.when(F.col("change") == change, F.col(c)))
    groups = hooks.groupBy(*keys, "prefix", "path").agg(F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"), of("added", "key").alias("to"), of("removed", "key").alias("gone"), of("removed", "b_value").alias("b"), of("added", "h_value").alias("h")).where("n_added = 1 AND n_removed = 1")
    both = groups.select(*keys, F.lit("hook").alias("kind"), F.col("to").alias("key"), F.lit("changed").alias("change"), F.col("b").alias("b_value"), F.col("h").alias("h_value"), F.lit(True).alias("paired"))
    gone = groups.select(*keys, F.explode(F.array("to", "gone")).alias("key"))
    return null_safe_join(found, gone, [*keys, "key"], "left_anti").select(*keys, "kind", "key", "change", "b_value", "h_value", F.lit(False).alias("paired")).unionByName(both)


#: Commands that run another one.
WRAPPERS = ("sudo", "env", "time", "xargs")


def not_interpreted(kind: Column, key: Column) -> Column:
    """What of an entry nothing here reasons about, by the names of a closed list: parts of a command line, what
    wrappers run, assignments, redirects, paths in all respects, and what plugins bring."""
    rule = F.regexp_replace(key, r"^perm:[a-z]+:", "")
    tool, spec = F.regexp_extract(rule, r"(?s)^([^(]+)", 1), F.when(rule.rlike(r"(?s)^[^(]+\(.*\)$"), F.regexp_extract(rule, r"(?s)^[^(]+\((.*)\)$", 1))
    scoped = (kind == "perm") & spec.isNotNull() & (spec != "*")
    bash, word = scoped & (tool == "Bash"), F.regexp_extract(F.trim(spec), r"^(\S+)", 1)
    silent = tool.isin(*IGNORED_TOOLS) | F.startswith(tool, F.lit("mcp__")) | (tool.isin(*PATH_TOOLS) & F.startswith(spec, F.lit("*")))
    path = scoped & (tool != "Bash") & ~silent
    named = {
        "N-compound-command": bash & spec.rlike(r"&&|;|\|"),
        "N-wrapper-stripping": bash & word.isin(*WRAPPERS),
        "N-env-assignment": bash & word.rlike(r"^[A-Za-z_][A-Za-z0-9_]*="),
        "N-redirect": bash & spec.rlike("[<>]"),
        **{f"N-{what}": path for what in ("path-anchoring", "depth-semantics", "symlink-pairing")},
        "N-plugin-provided": key == "plugin_flag:enabledPlugins",
    }
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in named.items()]))


def interpreted(found: DataFrame, base: DataFrame, head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """With breadth, flags and shifted directions of permission rules and servers. A rule that the same string
    shadows in an earlier list, or that has a shape nothing evaluates, is neutral."""
    perm = F.col("kind") == "perm"
    listed, rule = F.regexp_extract("key", r"^perm:([a-z]+):", 1), F.regexp_replace("key", r"^perm:[a-z]+:", "")
    told = found.withColumns({"list": F.when(perm, listed), "rule_text": F.when(perm, rule), "side": F.when(F.col("change") == "removed", "b").otherwise("h")})
    held = lambda df, side: df.where("kind = 'perm'").select(*keys, F.lit(side).alias("side"), F.regexp_extract("key", r"^perm:([a-z]+):", 1).alias("l"), F.regexp_replace("key", r"^perm:[a-z]+:", "").alias("rule_text"))
    shadows = held(base, "b").unionByName(held(head, "h")).groupBy(*keys, "side", "rule_text").agg(F.bool_or(F.col("l") == "deny").alias("denied"), F.bool_or(F.col("l") == "ask").alias("asked"))
    told = null_safe_join(told, shadows, [*keys, "side", "rule_text"])
    shadowed = F.coalesce(((F.col("list") == "allow") & (F.col("denied") | F.col("asked"))) | ((F.col("list") == "ask") & F.col("denied")), F.lit(False))
    tool, spec = F.regexp_extract("rule_text", r"(?s)^([^(]+)", 1), F.when(F.col("rule_text").rlike(r"(?s)^[^(]+\(.*\)$"), F.regexp_extract("rule_text", r"(?s)^[^(]+\((.*)\)$", 1))
    inert = F.coalesce(spec.isNotNull() & (tool.isin(*IGNORED_TOOLS) | F.startswith(tool, F.lit("mcp__")) | ((F.col("list") == "allow") & tool.isin(*PATH_TOOLS) & F.startswith(spec, F.lit("*")))), F.lit(False))
    inner = spec.rlike(r"(?s)\*.") & ~spec.rlike(r"(?s)^[^*]* \*$")
    bash = tool == "Bash"
    breadth = F.when(perm, F.when(spec.isNull() | (spec == "*"), "whole_tool").when(bash & spec.rlike(r"(?s)\*.") & ~spec.rlike(r"(?s)^.* \*$"), "glob").when(bash & spec.rlike(r" \*$"), F.when(inner, "glob").otherwise("prefix")).when(bash & ~F.contains(spec, F.lit("*")), "exact").when(bash, "glob").otherwise("unknown"))
    told = told.withColumns({"shadowed": shadowed, "inert": inert, "breadth": breadth, "unread": not_interpreted(F.col("kind"), F.col("key"))})
    url = F.get_json_object(F.coalesce("h_value", "b_value"), "$.url")
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    local = host.rlike(r"^(?:localhost|\[?::1\]?|127(?:\.\d{1,3}){3})$")
    variable = F.coalesce(url, F.get_json_object(F.coalesce("h_value", "b_value"), "$.command")).rlike(r"\$\{?[A-Za-z_]")
    server = F.col("kind") == "mcp"
    plain = server & url.rlike("(?i)^http://") & ~local & ~F.coalesce(variable, F.lit(False))
    broad = F.coalesce(bash & inner & perm, F.lit(False))
    direction = F.coalesce(*[F.when(F.col("rule") == r, d) for r, (d, _) in RULES.items()])
    tier = F.coalesce(*[F.when(F.col("rule") == r, t) for r, (_, t) in RULES.items()])
    mode_unknown = (F.col("kind") == "mode") & ~F.coalesce("h_value", "b_value").isin(*WIDENING, *PLAIN)
    flags = F.array_compact(F.array(F.when(F.col("shadowed"), "shadowed"), F.when(F.col("inert"), "ignored"), F.when(F.col("breadth") == "glob", "breadth_unresolved"), F.when(broad, "broad"), F.when(plain, "plaintext"), F.when(server & F.coalesce(variable, F.lit(False)), "variable_reference")))
    return told.withColumns(
        {
            "direction": F.when(F.col("shadowed") | F.col("inert"), "neutral").otherwise(direction),
            "tier": F.when(F.col("shadowed"), "projected").when(mode_unknown | (server & F.coalesce(variable, F.lit(False))) | (F.size("unread") > 0), "unresolved").otherwise(tier),
            "flags": flags,
        }
    )


def changes(base: DataFrame, head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, kind, key, change (added, removed, changed, moved), rule, direction, tier, breadth, flags, category and
    unread (what nothing reasons about) of the entries of two snapshots (files: keys, path, content) that differ.
    keys tell the snapshots of many projects apart."""
    keys = list(keys)
    before, after = entries(base, keys), entries(head, keys)
    side = lambda df, name: df.withColumn("side", F.lit(name))
    of = lambda name: F.array_sort(F.collect_set(F.when(F.col("side") == name, F.struct("value", "path"))))
    both = side(before, "b").unionByName(side(after, "h")).groupBy(*keys, "kind", "key").agg(of("b").alias("b"), of("h").alias("h"))
    values = lambda c: F.array_distinct(F.transform(c, lambda e: e["value"]))
    change = F.when(F.size("b") == 0, "added").when(F.size("h") == 0, "removed").when(values("b") != values("h"), "changed").when(F.col("b") != F.col("h"), "moved")
    one = lambda c, f: F.try_element_at(c, F.lit(1))[f]
    raw = both.withColumns({"change": change, "b_value": one("b", "value"), "h_value": one("h", "value"), "b_path": one("b", "path"), "h_path": one("h", "path")}).where("change IS NOT NULL").drop("b", "h")
    found = paired_hooks(raw, keys).withColumn("rule", _direction_rule())
    told = interpreted(found, before, after, keys)
    category = F.when(F.col("direction") == "widens", F.when(F.col("rule") == "D-allow-added", F.when(F.col("breadth") == "whole_tool", "whole-tool-allow").otherwise("scoped-allow")).otherwise(F.coalesce(*[F.when(F.col("rule") == r, c) for r, c in CATEGORIES.items()])))
    return told.withColumn("category", category).select(*keys, "kind", "key", "change", "rule", "direction", "tier", "breadth", "flags", "category", "unread")


def verdict(found: DataFrame, fail_on: Sequence[str] = (), *, projected: bool = False, strict: bool = False, keys: Sequence[str] = (), among: DataFrame | None = None) -> DataFrame:
    """One row (one for each of the keys, those of `among` without a change too): counts by direction, the verdict, and exit_code: 3 where a file could not be read, 1 where a proven
    change widens a failing category (or a projected one, if asked), 2 where something is undecided (1 if
    strict), else 0. Unknown categories are errors."""
    known = {*FAILING, "scoped-allow"}
    if set(fail_on) - known:
        raise ValueError(f"unknown category: {sorted(set(fail_on) - known)}")
    failing = list(fail_on) or list(FAILING)
    unreadable, widens = F.col("kind") == "unreadable", F.col("direction") == "widens"
    undecided = ~unreadable & ((F.col("tier") != "proven") | F.array_contains("flags", "breadth_unresolved"))
    fails = widens & (((F.col("tier") == "proven") & F.col("category").isin(*failing)) | (F.lit(projected) & ((F.col("tier") == "projected") | F.col("breadth").isin("prefix", "glob"))))
    of = lambda name: F.count_if(~unreadable & (F.col("direction") == name)).alias(name)
    sums = found.groupBy(*keys).agg(of("widens"), of("narrows"), of("neutral"), of("unknown"), F.count_if(unreadable).alias("unreadable"), F.count_if(F.coalesce(fails, F.lit(False))).alias("failing"), F.count_if(undecided).alias("undecided"), F.count("*").alias("n"))
    if keys and among is not None:
        sums = null_safe_join(among.select(*keys).distinct(), sums, keys).fillna(0, [c for c in sums.columns if c not in keys])
    said = F.when(F.col("unreadable") > 0, "incomplete").when(F.col("failing") > 0, "expands").when(F.col("undecided") > 0, "undecided").when(F.col("n") == 0, "no-change").otherwise("pass")
    code = F.when(F.col("unreadable") > 0, 3).when(F.col("failing") > 0, 1).when(F.col("undecided") > 0, 1 if strict else 2).otherwise(0)
    return sums.withColumn("verdict", said).withColumn("exit_code", code).drop("n")


def _files(spark: SparkSession, sf_dir: str, head: bool) -> DataFrame:
    """A settings file for each supplier: rules, a mode and a directory out of its columns."""
    shift = 1 if head else 0
    rules = F.array(F.concat(F.lit("Bash(make t"), (F.col("s_suppkey") % 5).cast("string"), F.lit(":*)")), F.when((F.col("s_suppkey") + shift) % 3 == 0, "Read").otherwise("Edit"))
    deny = F.when((F.col("s_suppkey") + shift) % 4 == 0, F.array(F.lit("WebFetch"))).otherwise(F.array().cast("array<string>"))
    mode = F.when((F.col("s_nationkey") + shift) % 3 == 0, "plan").when((F.col("s_nationkey") + shift) % 3 == 1, "auto")
    permissions = F.struct(rules.alias("allow"), deny.alias("deny"), mode.alias("defaultMode"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("path"), F.to_json(F.struct(permissions.alias("permissions"))).alias("content"))


@query("""WITH p AS (SELECT unnest(['perm:allow:Bash(make t' || s_suppkey % 5 || ' *)', CASE WHEN s_suppkey % 3 = 0 THEN 'perm:allow:Read' ELSE 'perm:allow:Edit' END, CASE WHEN s_suppkey % 4 = 0 THEN 'perm:deny:WebFetch' END, CASE WHEN s_nationkey % 3 < 2 THEN 'mode:defaultMode' END]) AS key, s_name AS path FROM supplier)
    SELECT split_part(key, ':', 1) AS kind, key, count(DISTINCT path) AS files FROM p WHERE key IS NOT NULL GROUP BY ALL""")
def settings_entries(spark, sf_dir):
    return entries(_files(spark, sf_dir, False)).groupBy("kind", "key").agg(F.count_distinct("path").alias("files"))


#: Where values stand that entries() reads, as pointers: a number for any place, a star for any name.
READ = ("/permissions/allow/0", "/permissions/ask/0", "/permissions/deny/0", "/permissions/defaultMode", "/permissions/additionalDirectories/0", "/env/*", "/hooks/*/0/matcher", "/hooks/*/0/hooks/0/type", "/hooks/*/0/hooks/0/command", "/hooks/*/0/hooks/0/timeout")
READ += tuple(f"/mcpServers/*/{c}" for c in ("command", "args/0", "url", "type", "env/*", "headers/*")) + ("/enableAllProjectMcpServers", "/disableAllHooks")


def leaves(documents: DataFrame, value: str = "content") -> DataFrame:
    """The other columns of documents beside pointer (of RFC 6901, names escaped) and leaf (JSON) of each scalar and
    each empty object or array of the JSON in `value`; text that is no JSON has none.

    Each round takes all values apart by one level, those that are left are whole, so a round is as wide as
    the documents are together and there are as many as the deepest has levels."""
    others = [c for c in documents.columns if c != value]
    # A small file is few tasks, however long its texts take.
    dealt = documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    front = dealt.select(*others, F.lit("").alias("pointer"), F.try_parse_json(value).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        entries, items = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
        inner = F.when(entries.isNotNull(), F.transform(F.map_entries(entries), lambda e: F.struct(F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")).alias("name"), e["value"].alias("v")))).when(items.isNotNull(), F.transform(items, lambda x, i: F.struct(i.cast("string").alias("name"), x.alias("v"))))
        level = front.withColumn("inner", inner)
        whole = level.where("inner IS NULL OR size(inner) = 0").select(*others, "pointer", F.to_json("v").alias("leaf"))
        found = whole if found is None else found.unionByName(whole)
        front = checkpointed(level.where("size(inner) > 0").select(*others, "pointer", F.explode("inner").alias("e")).select(*others, F.concat("pointer", F.lit("/"), "e.name").alias("pointer"), "e.v"), "leaves")
        if front.isEmpty():
            return found


def at_pointer(value: Column, pointer: Column) -> Column:
    """The JSON at a pointer in JSON text; null where nothing is there."""
    names = F.transform(F.filter(F.split(pointer, "/"), lambda _, i: i > 0), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    place = lambda t: F.when(t.rlike("^(?:0|[1-9][0-9]*)$"), t.try_cast("int"))
    # Written by to_json, so the first character tells what it is, and it is read as that alone.
    step = lambda held, t: F.when(F.startswith(held, F.lit("{")), F.try_element_at(F.from_json(held, "map<string,variant>"), t)).when(F.startswith(held, F.lit("[")), F.get(F.from_json(held, "array<variant>"), place(t)))
    return F.reduce(names, F.to_json(F.try_parse_json(value)), lambda held, t: F.to_json(step(held, t)))


def is_read(pointer: Column) -> Column:
    """Whether entries() reads what stands at a pointer."""
    known = "|".join(p.replace("0", "[0-9]+").replace("*", "[^/]+") for p in READ)
    return pointer.rlike(f"^(?:{known}|/enabledPlugins(?:/.*)?)$")
