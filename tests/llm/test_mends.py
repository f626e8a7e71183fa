"""Layouts, odd records, clashing names and large pages that operators must handle; stage files that prune."""

import os
import random
import sys
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF_SMALL, spark  # noqa: E402,F401

from winnow.llm import chatformat, mixing, ngramjoin, sharding, wrapper  # noqa: E402
from winnow.session import scratch_path  # noqa: E402

STORY = "<p>" + "some words of the story. " * 8 + "</p>"
TEXT = "some words of the story. " * 7 + "some words of the story."


def alone(page):
    return wrapper.main_text(wrapper.prepare(wrapper.parse(page)), None, set())


@pytest.mark.parametrize("page", [
    f'<body><div class="layout has-sidebar"><article>{STORY}</article></div><div class="sidebar">menu</div>',
    f'<body><div class="elementor-widget-container"><article>{STORY}</article></div>',
    f'<body><article><div class="elementor-widget-container">{STORY}</div></article>',
    f'<body><div class="no-comments">{STORY}</div>',
    f'<body><div class="post ad-free">{STORY}</div>',
    f'<body><form action="/"><input name="s"><div><article>{STORY}</article></div></form>',
    f'<body><form action="/">{STORY}<input></form><div class="cookie-notice">we use cookies</div>',
])
def test_layout_marks_lose_no_article(page):
    assert alone(page) == TEXT


def test_marked_widgets_together_are_the_article():
    page = "<body><article>" + "".join(f'<div class="elementor-widget"><p>part {k} of it</p></div>' for k in range(9)) + "</article>"
    assert alone(page) == "\n".join(f"part {k} of it" for k in range(9))


def test_boilerplate_still_goes():
    page = (f'<body><article><p>short</p><div class="comments">{STORY}</div><div class="newsletter">join now</div>'
            f'<form>mail <input></form></article><div class="widget">{STORY}</div>')
    assert alone(page) == "short"


def test_large_pages_take_seconds():
    rng = random.Random(1)
    kinds = ["<p>a</p>", "<div><p>b</p></div>", "<ul><li>x<li>y</ul>", "<h2>t</h2>", "<div><div>z</div><p>q</p></div>"]
    t = time.time()
    a, b = (wrapper.parse("<body><div>" + "".join(rng.choices(kinds, k=20_000)) + "</div>") for _ in range(2))
    wrapper.prepare(a), wrapper.prepare(b)
    pairs = wrapper.match(a, b)
    assert all(x.tag == y.tag for x, y in pairs) and len({x.at for x, _ in pairs}) == len(pairs) == len({y.at for _, y in pairs})
    assert len(pairs) > 20_000
    wrapper.prepare(wrapper.parse("<i>" * 20_000 + "<p>x" * 20_000))
    wrapper.prepare(wrapper.parse("<b>" * 100_000 + "x"))
    wrapper.parse("<a " * 100_000)
    assert time.time() - t < 60


ODD = ['{"messages":["hi"]}', '{"prompt":1,"completion":"x"}', '{"messages":[{"role":"user","content":5}]}', "{not json", "",
       '{"a":' * 2000 + "1" + "}" * 2000, "[1,2]", "7", '{"conv_id":"x","turn":0,"role":"user","text":"t"}',
       '{"conv_id":1,"turn":"two","role":"user","text":"t"}', '{"conv_id":1.5,"turn":0,"role":"user","text":"t"}', "[" * 5000,
       '{"messages":[{"role":"user","content":"a"},"b"]}', '{"messages":[]}', None, '{"messages":null}', '{"instruction":{"x":"y"}}']


def test_odd_records_are_kept_as_rows(spark):  # noqa: F811
    good = {100: '{"conv_id":7,"turn":3,"role":"human","text":"t"}', 101: '{"conv_id":null,"turn":null,"role":null,"text":null}',
            102: '{"messages":[{"role":"user","content":null}]}', 103: '{"conv_id":8,"turn":"4","role":"bot","text":"u"}'}
    df = spark.createDataFrame([*enumerate(ODD), *good.items()], "id long, j string").repartition(3)
    got = [tuple(r) for r in chatformat.canonical_turns(df, "id", "j").select("conv", "turn", "role", "text").collect()]
    assert {(k, None, None, t) for k, t in enumerate(ODD)} <= set(got) and len(got) == len(ODD) + len(good)
    assert {(7, 3, "user", "t"), (None, None, None, None), (102, 0, "user", None), (8, 4, "assistant", "u")} <= set(got)


NAMES = ["_i", "_s", "_z", "_c", "_i2", "_z2", "_c2", "_no", "_no2", "_shard", "_slot", "shard", "slot", "curve", "rank", "size",
         "id", "total", "mix_id", "mix_no", "mix_copies", "n_copies", "c0", "c1", "_d0", "_at", "_part", "bytes", "text_crc32"]


def test_clashing_names_in_stages(spark):  # noqa: F811
    rows = [(k, f"word {k} " * (k % 7), "en", "st"[k % 2], *[f"{n}{k}" for n in NAMES]) for k in range(40)] + [
        (None, None, None, None, *[None] * len(NAMES))] * 2
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES)
    df = spark.createDataFrame(rows, schema).repartition(3)
    out = sharding.sharded(df, 4)
    assert out.columns[:len(df.columns)] == df.columns and len(set(c.lower() for c in out.columns)) == len(out.columns)
    plain = out.select(*df.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, df.collect()))
    m = mixing.mixed(df)
    assert m.columns == df.columns and set(map(str, m.collect())) <= set(map(str, df.collect()))
    assert ngramjoin.keep_one(df).columns == df.columns


def test_shard_files_prune(spark):  # noqa: F811
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 1000)).repartition(8)
    path = scratch_path(spark, "shards")
    sharding.sharded(docs, 8).write.parquet(path)                # as the pipeline writes the stage: no further shuffle
    local = path.removeprefix("file:")
    spans = []
    for f in sorted(os.listdir(local)):
        if f.endswith(".parquet"):
            t = pq.read_table(os.path.join(local, f), columns=["shard", "slot"])
            rows = list(zip(t["shard"].to_pylist(), t["slot"].to_pylist()))
            assert rows == sorted(rows)
            g = pq.ParquetFile(os.path.join(local, f)).metadata
            stats = [g.row_group(0).column(g.schema.names.index(n)).statistics for n in ("source", "lang")]
            spans.append((rows[0], rows[-1], *[(s.min, s.max) for s in stats]))
    spans.sort()
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))        # stretches of the curve
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]
    opened = [sum(s[3][0] <= x <= s[3][1] for s in spans) for x in langs]
    assert sum(opened) < len(langs) * len(spans)


def test_long_lists_align_exactly():
    """A block moved far from its place, in lists of more than 16,384 pairs: no band around the diagonal."""
    def page(kinds):
        root = wrapper.parse("<body><div><h1>a</h1>" + "".join(kinds) + "<pre>z</pre></div>")
        wrapper.prepare(root)
        return root
    table, end = "<table><tr><td>x</td></tr></table>", "<h3>end</h3>"
    a = page(["<p>t</p>"] * 150 + [table] * 200 + [end])
    b = page([table] * 200 + ["<p>t</p>"] * 150 + [end])
    pairs = wrapper.match(a, b)
    n = sum(x.tag == "table" for x, _ in pairs)
    assert n == 200 and all(x.tag == y.tag for x, y in pairs)      # the tables weigh more than the paragraphs
    rng = random.Random(3)
    kinds = ["<p>a</p>", "<div><p>b</p></div>", "<ul><li>x<li>y</ul>", "<div><div>z</div><p>q</p></div>"]
    for size in (20, 170):
        a, b = (page(rng.choices(kinds, k=size)) for _ in range(2))
        xs, ys = (wrapper._kids(wrapper._kids(wrapper._kids(r)[0])[0]) for r in (a, b))
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        sizes = {}
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                key = (x.size, y.size)
                if key not in sizes:
                    sizes[key] = len(wrapper.match(x, y)) if x.tag == y.tag else 0
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + sizes[key])
        def weight(u, v):
            return sizes[u.size, v.size]
        assert wrapper._aligned(xs, ys, weight, False) == m[-1][-1]
        assert sum(sizes[u.size, v.size] for u, v in wrapper._aligned(xs, ys, weight, True)) == m[-1][-1]


def test_wrapper_reads_equal_attributes_and_a_hosts_statistics_once(monkeypatch):
    """Attributes that repeat are read once; the statistics of a host, as long as its page, aren't read for each page."""
    import pyarrow as pa
    read, calls = wrapper.attributes, []
    monkeypatch.setattr(wrapper, "attributes", lambda x: calls.append(x) or read(x))
    body = "".join(f'<div class="once-read"><p class="para-read">paragraph {k}</p></div>' for k in range(50))
    assert alone(f"<body>{body}").count("\n") == 49
    assert len(calls) <= 8

    class Stats(list):
        as_py_calls = 0
        is_valid = True

        def as_py(self):
            Stats.as_py_calls += 1
            return list(self)
    got = wrapper._References()
    row = Stats([{"node": 0, "n": 3, "same": 0, "chars": 9, "has": 0}])
    for _ in range(5):
        got.get("host", f"<body>{body}", row)
    assert Stats.as_py_calls == 1
    pages = [f"<body><p>menu</p><article><p>text {k}</p></article>" for k in range(6)]
    stats = [[{"node": k, "n": 6, "same": 6 if k == 2 else 0, "chars": 5, "has": 0} for k in range(5)]] * 5 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["u"] * 6), pa.array(["h"] * 6), pa.array(pages),
                                        pa.array([pages[0]] * 6), pa.array(stats)], names=list("abcdef"))
    texts = [t for b in wrapper._extract([batch]) for t in b.column(2).to_pylist()]
    assert texts == [f"text {k}" for k in range(6)]


def test_mix_of_many_documents_ships_no_text(spark):
    n = 100_100
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 7 as int))").alias("text"),
                               F.expr("element_at(array('a', 'b', null), cast(id % 3 + 1 as int))").alias("source"))
    df = df.unionByName(df.limit(5))                        # repeated rows
    m = mixing.mixed(df)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    want = mixing.mix(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    got = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert want.exceptAll(got).count() == 0 == got.exceptAll(want).count()
