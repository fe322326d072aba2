"""Directions of changes between two snapshots of settings, case by case."""

import hashlib
import json

import pytest

from meterloom.plans import settings_diff

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


def frame(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)], "path string, content string")


def hook(command, **more):
    return {"Stop": [{"matcher": "x", "hooks": [{"type": "command", "command": command, **more}]}]}


def test_directions(spark):
    one = {
        "permissions": {"allow": ["Bash(ls:*)", "Read"], "ask": ["Bash(rm *)"], "deny": ["Write", "Bash(git push)"], "defaultMode": "default", "additionalDirectories": ["/a"]},
        "env": {"PATH": "/bin", "COLOR": "red", "OLD": "1"},
        "hooks": hook("run"),
        "mcpServers": {"s": {"command": "srv"}, "t": {"url": "https://a", "headers": {"x": "1"}}, "gone": {"command": "c"}},
        "disableAllHooks": True,
    }
    two = {
        "permissions": {"allow": ["Bash(ls *)", "Bash(*)", "Bash(git push)", "Bash(npm test)", "Bash(git * main)", "Glob(src/**)", "Read(*.env)"], "deny": ["Bash(git push)"], "defaultMode": "dontAsk", "additionalDirectories": ["/b"]},
        "env": {"PATH": "/usr/bin", "COLOR": "blue", "NEW": "1", "LD_PRELOAD": "x"},
        "hooks": hook("run2"),
        "mcpServers": {"s": {"command": "srv", "args": ["-v"]}, "t": {"url": "https://a", "headers": {"x": "2"}}, "new": {"type": "http", "url": "http://example.org/x"}, "here": {"type": "http", "url": "http://127.0.0.1:1"}, "var": {"url": "https://${HOST}/"}},
        "enableAllProjectMcpServers": True,
    }
    got = {r.key: (r.change, r.rule, r.direction, r.tier, r.breadth, tuple(r.flags), r.category) for r in settings_diff.changes(frame(spark, one), frame(spark, two)).collect()}
    assert got == {
        "perm:allow:Read": ("removed", "D-allow-removed", "narrows", "proven", "whole_tool", (), None),
        "perm:allow:Bash(*)": ("added", "D-allow-added", "widens", "proven", "whole_tool", (), "whole-tool-allow"),
        "perm:allow:Bash(git push)": ("added", "D-allow-added", "neutral", "projected", "exact", ("shadowed",), None),
        "perm:allow:Bash(npm test)": ("added", "D-allow-added", "widens", "proven", "exact", (), "scoped-allow"),
        "perm:allow:Bash(git * main)": ("added", "D-allow-added", "widens", "proven", "glob", ("breadth_unresolved", "broad"), "scoped-allow"),
        "perm:allow:Glob(src/**)": ("added", "D-allow-added", "neutral", "proven", "unknown", ("ignored",), None),
        "perm:allow:Read(*.env)": ("added", "D-allow-added", "neutral", "proven", "unknown", ("ignored",), None),
        "perm:ask:Bash(rm *)": ("removed", "D-ask-removed", "neutral", "proven", "prefix", (), None),
        "perm:deny:Write": ("removed", "D-deny-removed", "widens", "proven", "whole_tool", (), "deny-removed"),
        "mode:defaultMode": ("changed", "D-mode-widened", "widens", "proven", None, (), "mode"),
        "dir:/a": ("removed", "D-dir-removed", "narrows", "proven", None, (), None),
        "dir:/b": ("added", "D-dir-added", "widens", "proven", None, (), "directory"),
        "env_key:PATH": ("changed", "D-env-sensitive-set", "widens", "proven", None, (), "env"),
        "env_key:LD_PRELOAD": ("added", "D-env-sensitive-set", "widens", "proven", None, (), "env"),
        "env_key:COLOR": ("changed", "D-env-value-changed", "unknown", "unresolved", None, (), None),
        "env_key:NEW": ("added", "D-unknown", "unknown", "unresolved", None, (), None),
        "env_key:OLD": ("removed", "D-unknown", "unknown", "unresolved", None, (), None),
        f"hook:Stop:x:{SHA('run2')}": ("changed", "D-hook-changed", "widens", "proven", None, (), "hook"),
        "mcp:s": ("changed", "D-mcp-changed", "widens", "proven", None, (), "mcp"),
        "mcp:t": ("changed", "D-env-value-changed", "unknown", "unresolved", None, (), None),
        "mcp:gone": ("removed", "D-mcp-removed", "narrows", "proven", None, (), None),
        "mcp:new": ("added", "D-mcp-added", "widens", "proven", None, ("plaintext",), "mcp"),
        "mcp:here": ("added", "D-mcp-added", "widens", "proven", None, (), "mcp"),
        "mcp:var": ("added", "D-mcp-added", "widens", "unresolved", None, ("variable_reference",), "mcp"),
        "plugin_flag:disableAllHooks": ("removed", "D-hooks-reenabled", "widens", "proven", None, (), "hooks-reenabled"),
        "plugin_flag:enableAllProjectMcpServers": ("added", "D-enable-all-mcp", "widens", "proven", None, (), "mcp"),
    }


def verdict(spark, one, two, **options):
    row = settings_diff.verdict(settings_diff.changes(frame(spark, one), frame(spark, two)), **options).first()
    return row.verdict, row.exit_code


def test_verdicts(spark):
    allow = lambda *rules: {"permissions": {"allow": list(rules)}}
    assert verdict(spark, allow("Read"), json.dumps(allow("Read"), indent=3)) == ("no-change", 0)
    assert verdict(spark, allow(), allow("Read")) == ("expands", 1)
    assert verdict(spark, allow(), allow("Bash(npm test)")) == ("pass", 0)
    assert verdict(spark, allow(), allow("Bash(npm test)"), fail_on=["scoped-allow"]) == ("expands", 1)
    assert verdict(spark, allow(), allow("Bash(a * b)")) == ("undecided", 2)
    assert verdict(spark, allow(), allow("Bash(a * b)"), strict=True) == ("undecided", 1)
    assert verdict(spark, allow(), allow("Bash(npm run *)"), projected=True) == ("expands", 1)
    assert verdict(spark, allow("Read"), "{") == ("incomplete", 3)
    assert verdict(spark, {"hooks": hook("run")}, {"hooks": hook("run", timeout=5)}) == ("pass", 0)
    with pytest.raises(ValueError):
        verdict(spark, {}, {}, fail_on=["everything"])
