import json

import numpy as np
import pytest

from calembour.config import load_settings
from calembour.operators import providers as P
from calembour.plans import pipelines
from calembour.sources import files


def test_contract(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c")], "k int, prompt string")
    recorded = spark.createDataFrame([("a", 'x {"n": 1, "w": "q"} y')], "prompt string, response string")
    answers = {"b": 'first {"w": "r", "n": 2} then {', "c": '{"w": "s"}'}
    got = {r["k"]: (r["n"], r["w"], r["error"]) for r in P.parsed(P.ask(df, "prompt", P.Stub(answers.__getitem__), recorded), "n int, w string").collect()}
    assert got[1] == got[3] == (1, "q", None)
    assert got[2] == (2, "r", None)
    assert got[4] == (None, None, "no response")
    assert got[5] == (None, "s", None)


def test_an_exception_becomes_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "k int, prompt string")

    def fail(_):
        raise ValueError("down")

    assert P.parsed(P.ask(df, "prompt", P.Stub(fail)), "n int").first()["error"].startswith("ERROR ValueError")
    P.register("stub", lambda: P.Stub(str.upper))
    assert P.provider("stub").answer(["a"]) == ["A"]
    with pytest.raises(KeyError):
        P.provider("other")


def test_stages_run_on_recorded_answers(spark):
    df = spark.createDataFrame([(1, "t")], "rec_id bigint, text_clean string")
    rule = P.Stub(lambda p: '{"pun_word": "w", "pun_type": "homophonic", "first_meaning": ["a"], "second_meaning": ["b"], "first_context": [], "second_context": [], "pun_word_fr": "v", "first_meaning_fr": ["c"], "second_meaning_fr": ["d"], "generated_pun": "g", "is_pun": 1, "is_homonym": 1, "first_meaning_overlap": 1, "second_meaning_overlap": 0}')
    one = pipelines.identify(df, rule)
    two = pipelines.translate(one.drop("error"), rule)
    r = pipelines.generate(two.drop("error"), rule).first()
    assert (r["pun_word"], r["pun_word_fr"], r["generated_pun"]) == ("w", "v", "g")
    h = pipelines.homonym(two.drop("error"), P.Stub(lambda p: "no")).first()
    assert (h["is_homonym"], h["direct"]) == (-1, 0)


def test_aligned_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x"]), (2, [], ["z"])], "k int, s array<string>, b array<string>")
    sim = spark.createDataFrame([("b", "x", 0.5)], "a string, b string, similarity double")
    got = {r["k"]: (r["mean_similarity"], r["problems"]) for r in pipelines.compared_lists(df, "k", "s", "b", sim).collect()}
    assert got == {1: (0.75, 1), 2: (None, 0)}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "l1\nl2", "x")], "i int, t string, u string")
    for kind in ("csv", "json", "parquet"):
        p = f"{tmp_path}/t.{kind}"
        files.save(df, p)
        back = spark.read.json(p) if kind == "json" else files.load(spark, p, "i int, t string, u string", fill=False)
        assert sorted((r["i"], r["t"], r["u"]) for r in back.collect()) == [(1, 'a "q", b', None), (2, "l1\nl2", "x")]
    files.save(df.where("i = 1").select("t"), f"{tmp_path}/t.tsv")
    assert files.load(spark, f"{tmp_path}/t.tsv", "t string").count() == 1
    (tmp_path / "a.json").write_text('[{"x": {"y": 1, "z": {"w": "q"}}, "v": null}, {"x": null, "v": "s"}]')
    flat = files.load_flat_json(spark, f"{tmp_path}/a.json")
    assert set(flat.columns) == {"v", "x.y", "x.z.w"} and flat.count() == 2
    (tmp_path / "n.csv").write_text("w,v\nnull,NA\nx,y\n")
    assert [tuple(r) for r in files.load(spark, f"{tmp_path}/n.csv", missing=True).collect()] == [("", ""), ("x", "y")]
    (tmp_path / "plain.txt").write_text("one\ntwo")
    assert files.load(spark, f"{tmp_path}/plain.txt").first()["text"] == "one\ntwo"


def test_chunks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "2.tsv").write_text("a\tb\nx\t\n")
    (tmp_path / "c" / "10.tsv").write_text("a\tb\ny\tz\n")
    got = sorted((r["chunk_no"], r["a"], r["b"]) for r in files.load_chunks(spark, f"{tmp_path}/c", "a string, b string").collect())
    assert got == [(2, "x", ""), (10, "y", "z")]
    (tmp_path / "e").mkdir()
    assert files.load_chunks(spark, f"{tmp_path}/e", "a string").count() == 0
    assert files.chunk_number("m2/13.tsv") == 13 and files.chunk_number("x") is None


def test_lexicon_and_matrix(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("Ortho\tPHON\nVer\tvEr\n\tx\n")
    assert [(r["word"], r["phon"]) for r in files.load_lexicon(spark, f"{tmp_path}/l.tsv").collect()] == [("ver", "vEr")]
    (tmp_path / "m.csv").write_text("word,other\na,b\n")
    with pytest.raises(ValueError):
        files.load_lexicon(spark, f"{tmp_path}/m.csv")
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert files.load_matrix(spark, f"{tmp_path}/m.npy").count() == 3


def test_cache_and_settings(spark, tmp_path, monkeypatch):
    cache = spark.createDataFrame([("a", 1)], "word string, v int")
    hit, miss = files.cached_lookup(spark.createDataFrame([("a",), ("b",), ("b",)], "word string"), cache, "word")
    assert hit.count() == 1 and [r["word"] for r in miss.collect()] == ["b"]
    (tmp_path / "c.ini").write_text("[path]\ncleaned = x\n[dir]\ntranslate = t\n")
    monkeypatch.setenv("CALEMBOUR_PATH_CLEANED", "y")
    s = load_settings(f"{tmp_path}/c.ini")
    assert s.path["cleaned"] == "y" and s.stage("translate") == "t" and load_settings("absent.ini").model == {}


def test_json_as_array_and_by_line(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    for name, text in (("array", "[\n" + ",\n".join(map(json.dumps, rows)) + "]"), ("one", json.dumps(rows)), ("lines", "\n" + "\n".join(map(json.dumps, rows))), ("pretty", json.dumps(rows[0], indent=1)), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
        got = sorted((r["a"], r["b"]) for r in files.load(spark, str(tmp_path / f"{name}.json"), "a int, b string").collect())
        assert got == {"pretty": [(1, "x")], "empty": []}.get(name, [(1, "x"), (2, "y")]), name
    files.save(spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").coalesce(1), str(tmp_path / "saved.json"))
    assert files.load(spark, str(tmp_path / "saved.json"), "a int, b string").count() == 2


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from calembour.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf={}))
