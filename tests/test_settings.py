import pytest

from lodestone.sources import settings

pytest.importorskip("yaml")


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_aliases_take_their_folder_as_namespace(spark, tmp_path):
    put(tmp_path, "docker/aliases.yaml", "- name: ps\n  desc: list\n  alias: docker ps {{ who }}\n- name: up\n  alias: docker up\n")
    put(tmp_path, "git/aliases.yml", "")
    put(tmp_path, "git/other.yaml", "- name: no\n  alias: no\n")
    got = settings.read_aliases(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("docker", "ps", "list", "docker ps {{ who }}"), ("docker", "up", None, "docker up")]


def test_a_blank_in_a_name_is_an_error(spark, tmp_path):
    put(tmp_path, "x/aliases.yaml", "- name: a b\n  alias: c\n")
    with pytest.raises(Exception, match="holds a blank"):
        settings.read_aliases(spark, str(tmp_path)).collect()


def test_vars_and_choices(spark, tmp_path):
    put(tmp_path, "ns/vars.yaml", "- name: dir\n  desc: where\n  choices:\n    - value: /tmp\n      desc: scratch\n    - value: 7\n- name: who\n  from_command: whoami\n")
    got = {r["name"]: r for r in settings.read_vars(spark, str(tmp_path)).collect()}
    assert [tuple(c) for c in got["dir"]["choices"]] == [("/tmp", "scratch"), ("7", None)]
    assert got["who"]["choices"] is None and got["who"]["from_command"] == "whoami" and got["who"]["namespace"] == "ns"
    put(tmp_path, "c.tsv", "a\tfirst\n\nb\nc\td\te\n")
    assert sorted(map(tuple, settings.read_choices(spark, str(tmp_path / "c.tsv")).collect()), key=str) == [("a", "first"), ("b", None), ("c", "d")]


def test_decision_log(spark, tmp_path):
    put(tmp_path, "log.yaml", "commit: abc\ndecisions:\n  - number: 1\n    title: One\n    code_impacts:\n      - reasoning: why\n        file: a.rs\n        line_ranges:\n          - {start: 1, end: 4}\n          - {start: 9, end: 9}\n  - number: 2\n    title: Two\n    rationale: r\n")
    got = sorted(map(tuple, settings.read_decisions(spark, str(tmp_path)).collect()), key=str)
    assert got == [("abc", 1, "One", None, "why", "a.rs", 1, 4), ("abc", 1, "One", None, "why", "a.rs", 9, 9), ("abc", 2, "Two", "r", None, None, None, None)]


def test_no_files(spark, tmp_path):
    put(tmp_path, "readme.txt", "x")
    assert settings.read_aliases(spark, str(tmp_path)).count() == 0
