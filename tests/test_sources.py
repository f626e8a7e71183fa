"""Sources, sinks and the selector registry."""

import os

import pytest
from pyspark.sql import functions as F

from winnow.plans import selectors as selx
from winnow.session import scratch_path
from winnow.sources import io


@pytest.mark.parametrize("path,kind", [("a/b.jsonl", "jsonl"), ("a.b/c", "jsonl"), ("a/b.csv", "csv"),
                                       ("a/b.parquet/", "parquet"), ("a/b.JSON", "json")])
def test_file_kind(path, kind):
    assert io.file_kind(path) == kind and kind in io.READERS


def _as_rows(df):
    return sorted((r.instruction, r.input, r.output) for r in df.collect())


def test_read_records_csv_header_and_quotes(spark):
    path = scratch_path(spark, "csv") + "/a.csv"
    _write_lines(path, ["instruction,input,output", '"say ""hi"", then', 'stop",,"x, y"'])
    assert _as_rows(io.read_records(spark, path)) == [('say "hi", then\nstop', None, "x, y")]


def test_read_records_json_array_and_lines(spark):
    base = scratch_path(spark, "json")
    a = '{"instruction": "i", "input": "", "output": "o"}'
    _write_lines(f"{base}/array.json", ["", " [", f"  {a},", '  {"instruction": "j",', '   "input": "k", "output": "p"}', "]"])
    _write_lines(f"{base}/lines.json", [a, '{"instruction": "j", "input": "k", "output": "p"}'])
    want = [("i", "", "o"), ("j", "k", "p")]
    assert _as_rows(io.read_records(spark, f"{base}/array.json")) == want
    assert _as_rows(io.read_records(spark, f"{base}/lines.json")) == want


def test_read_records_fails_loudly(spark):
    path = scratch_path(spark, "bad") + "/a.jsonl"
    _write_lines(path, ['{"instruction": "i"}', "{broken"])
    with pytest.raises(Exception):
        io.read_records(spark, path, schema=io.RECORD_SCHEMA).collect()
    with pytest.raises(ValueError):
        io.read_records(spark, "a.xlsx")


def _local(path):
    """The local file behind a ``file:`` URI (the session's scratch folder is local in tests)."""
    return path[len("file:"):] if path.startswith("file:") else path


def _write_lines(path, lines):
    path = _local(path)
    assert path.startswith("/")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_read_chat_sources_layouts_and_blank_lines(spark):
    base = scratch_path(spark, "chat-test")
    msg = '{"dataset": "x", "id": "1", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]}'
    _write_lines(f"{base}/cot_data.jsonl", [msg, "", msg])
    _write_lines(f"{base}/dolly/dolly_data.jsonl", [msg])
    df = io.read_chat_sources(spark, base, ["cot", "dolly"])
    got = {r.dataset: r["count"] for r in df.groupBy("dataset").count().collect()}
    assert got == {"cot": 2, "dolly": 1}


def test_read_chat_sources_flat_first(spark):
    base = scratch_path(spark, "chat-test")
    msg = '{"id": "%s", "messages": []}'
    _write_lines(f"{base}/cot_data.jsonl", [msg % "flat"])
    _write_lines(f"{base}/cot/cot_data.jsonl", [msg % "nested"])
    assert [r.id for r in io.read_chat_sources(spark, base, ["cot"]).collect()] == ["flat"]


def test_read_chat_sources_missing(spark):
    with pytest.raises(FileNotFoundError):
        io.read_chat_sources(spark, scratch_path(spark, "empty"), ["oasst1"])


def test_read_chat_sources_bad_json_fails(spark):
    base = scratch_path(spark, "chat-test")
    _write_lines(f"{base}/cot_data.jsonl", ['{"id": "1", "messages": []}', "{not json"])
    with pytest.raises(Exception):
        io.read_chat_sources(spark, base, ["cot"]).collect()


def test_write_jsonl_roundtrip_unicode_and_nulls(spark):
    df = spark.createDataFrame([("é ü", None, "x")], "instruction string, input string, output string")
    path = scratch_path(spark, "w") + "/out.jsonl"
    io.write_jsonl(df, path)
    local = _local(path)
    text = "".join(open(os.path.join(local, f), encoding="utf-8").read()
                   for f in os.listdir(local) if f.endswith(".json"))
    assert '"é ü"' in text and '"input":null' in text
    back = io.read_records(spark, path, schema=io.RECORD_SCHEMA).first()
    assert (back.instruction, back.input, back.output) == ("é ü", None, "x")


def test_build_if_missing_builds_once(spark):
    base = scratch_path(spark, "cache")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    a = io.build_if_missing(spark, base, "k=1", build)
    b = io.build_if_missing(spark, base, "k=1", build)
    c = io.build_if_missing(spark, base, "k=2", build)
    assert a.count() == b.count() == c.count() == 3 and len(calls) == 2


def test_build_if_missing_publishes_whole_tables(spark):
    base = scratch_path(spark, "cache")

    def slow():
        # another builder publishes while this one is at work
        io.build_if_missing(spark, base, "k", lambda: spark.range(5), fingerprint="a")
        return spark.range(9)
    assert io.build_if_missing(spark, base, "k", slow, fingerprint="a").count() == 5

    def dies():
        return spark.range(4).selectExpr("raise_error('dies') AS id")
    with pytest.raises(Exception, match="dies"):
        io.build_if_missing(spark, base, "d", dies)
    assert io.build_if_missing(spark, base, "d", lambda: spark.range(4)).count() == 4
    with pytest.raises(ValueError, match="was built from"):
        io.build_if_missing(spark, base, "k", lambda: spark.range(5), fingerprint="b")


def test_manifest_of_any_ids(spark):
    big = spark.createDataFrame([(2**62,), (2**62 + 1,), (2**62 + 2,)], "example_id long")
    text = big.selectExpr("cast(example_id AS string) AS example_id")
    a, b = (io.selection_manifest(d, "m", 0.1).first() for d in (big, text))
    assert a.num_selected == 3 and a.id_checksum == b.id_checksum
    assert io.selection_manifest(big.limit(2), "m", 0.1).first().id_checksum != a.id_checksum


def test_cluster_warmup_takes_from_every_cluster(spark):
    from winnow.operators import losses as ls
    rows = [(i, [f"c{i % 4}"] * 6 + [f"w{i}"]) for i in range(80)]
    tok = spark.createDataFrame(rows, "example_id long, tokens array<string>")
    got = [r.example_id for r in ls.cluster_warmup(tok, 0.1, clusters=4).collect()]
    assert len(got) == 8 and len(set(got)) == 8


def test_dataset_sizes(spark):
    t = spark.range(7)
    v = spark.range(2)
    got = {r.split: r.n for r in io.dataset_sizes(t, v).collect()}
    assert got == {"train": 7, "validation": 2}


def test_run_selection_unknown_method(spark):
    with pytest.raises(ValueError):
        selx.run_selection(spark.range(3), None, method="nope")


def test_run_selection_unknown_option(spark):
    ex = spark.createDataFrame([(0, "a")], "example_id long, text string")
    for method in ("random", "bm25", "embedding", "ppl", "ifd", "miwv", "less", "adapt"):
        with pytest.raises(TypeError):
            selx.run_selection(ex, ex, method=method, kep="high")


def test_register_selector_and_scorer(spark):
    ex = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(10)], "example_id long, text string")
    selx.register_selector("len_test", lambda e, v, **o: e.select("example_id", F.length("text").cast("double").alias("score")))
    assert sorted(r.example_id for r in selx.run_selection(ex, None, "len_test", 0.2).collect()) == [8, 9]

    def scorer(pdf):
        import pandas as pd
        return pd.DataFrame({"example_id": pdf["example_id"], "score": -pdf["example_id"].astype(float)})
    selx.register_scorer("neg_id_test", scorer, "example_id long, score double")
    assert sorted(r.example_id for r in selx.run_selection(ex, None, "neg_id_test", 0.2).collect()) == [0, 1]


def test_adapt_requires_validation(spark):
    with pytest.raises(ValueError):
        selx.run_selection(spark.range(3).withColumnRenamed("id", "example_id"), None, "adapt")


def test_compose_named_scorer_and_policies(spark):
    from conftest import SF_SMALL
    from winnow.sources import tables as tb
    ex, val = tb.examples(spark, SF_SMALL), tb.target(spark, SF_SMALL)
    hard = selx.compose(ex, val, "bm25", "hard", 0.05)
    assert hard.filter(F.col("weight") == 1.0).count() == 10 and hard.count() == ex.count()
    div = selx.compose(ex, val, "embedding", "diversity", 0.05)
    assert div.count() == 10
    with pytest.raises(ValueError):
        selx.compose(ex, val, "nope", "hard")
    from winnow.plans import queries as Q
    recs = Q.chat_records(spark, SF_SMALL)
    ppl = selx.compose(recs, None, "ppl", "topk", 0.2, scorer_options={"background": ex})
    picked = selx.run_selection(recs, None, "ppl", 0.2, background=ex)
    assert sorted(r.example_id for r in ppl.collect()) == sorted(r.example_id for r in picked.collect())


def test_run_selection_every_method(spark):
    from conftest import SF_SMALL
    from winnow.plans import queries as Q
    from winnow.sources import tables as tb
    docs, target = tb.examples(spark, SF_SMALL), tb.target(spark, SF_SMALL)
    recs = Q.chat_records(spark, SF_SMALL)
    train, val = Q._emb_parts(spark, SF_SMALL)
    vy = lambda d: d.withColumn("y", (F.col("label") < 5).cast("double"))
    cases = {
        "random": (docs, None, {}, 10),
        "bm25": (docs, target, {}, 10),
        "embedding": (docs, target.withColumnRenamed("item_id", "example_id"), {}, 10),
        "ppl": (recs, None, {"background": docs}, 1),
        "ifd": (recs, None, {"background": docs}, 1),
        "miwv": (recs, None, {"background": docs}, 1),
        "less": (vy(train), vy(val), {"steps": 2, "proj_dim": 16, "num_checkpoints": 2}, 24),
        "adapt": (docs, target, {}, 200),
    }
    for method, (ex, v, opts, n) in cases.items():
        assert selx.run_selection(ex, v, method=method, budget=0.05, **opts).count() == n, method
