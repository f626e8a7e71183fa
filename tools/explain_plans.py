"""Write the formatted physical plan of registered queries to a folder.

    python tools/explain_plans.py OUT_DIR [sf_dir] [name ...]

One ``<name>.txt`` per query (``explain("formatted")``), plus a summary line
per query on stdout: exchanges, broadcasts, sort-merge joins, Python
operators and parquet scans with their read schema.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from winnow.plans.queries import QUERIES  # noqa: E402
from winnow.session import get_spark  # noqa: E402

HEADLINE = ["select_bm25", "bm25_max", "mix_sources", "select_embedding", "nearest_neighbor",
            "select_ifd", "select_miwv", "influence_score", "weights_embed"]


def main() -> None:
    out_dir = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    names = sys.argv[3:] or HEADLINE
    os.makedirs(out_dir, exist_ok=True)
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(text)
        head = text.split("\n\n")[0]
        count = {k: head.count(k) for k in ("Exchange", "BroadcastExchange", "SortMergeJoin",
                                           "ArrowEvalPython", "MapInPandas", "MapInArrow",
                                           "FlatMapCoGroupsInPandas", "Scan parquet")}
        print(name, count)
    spark.stop()


if __name__ == "__main__":
    main()
