import json

import pytest
from test_sources import repo  # noqa: F401
from tidemark import cli
from tidemark.sources.tasks import task_text


def test_overview_json_and_gates(spark, repo, capsys):  # noqa: F811
    assert cli.main([str(repo), "HEAD~1..HEAD", "--task", "raise max tries zebra", "--fail-on", "crit"], spark) == 2
    text = capsys.readouterr().out
    assert "1. [Critical] src/crypto.rs — 2 symbols changed (priority 89" in text and "Task check [Partial]" in text and "2 files · +2 −5 · 2 meaningful" in text
    assert cli.main([str(repo), "HEAD~1", "HEAD", "--json"], spark) == 0
    document = json.loads(capsys.readouterr().out)
    assert document["schema_version"] == 1 and [i["id"] for i in document["review_items"]] == ["file:src/crypto.rs", "file:src/lib.rs"]
    assert cli.main([str(repo), "HEAD~1..HEAD", "--escalate", "--local-judge"], spark) == 0
    assert "Escalation package — 1 item(s)" in capsys.readouterr().out
    assert cli.main([str(repo), "HEAD~1..HEAD", "--format", "github"], spark) == 0
    assert capsys.readouterr().out.startswith("::error file=src/crypto.rs,title=Critical")


def test_bad_calls(spark, tmp_path, capsys):
    with pytest.raises(SystemExit):
        cli.arguments(["--escalate", "--format", "junit"])
    assert cli.main([str(tmp_path)], spark) == 1
    assert "not a git repository" in capsys.readouterr().err


def test_task_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n do it \t\n")
    assert task_text(spark, f"@{tmp_path}/t.txt") == "do it" and task_text(spark, " x ") == "x"
    with pytest.raises(ValueError, match="empty"):
        task_text(spark, "  ")
