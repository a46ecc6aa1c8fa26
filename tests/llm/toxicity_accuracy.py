"""Precision and recall of op3_toxicity on the held-out labelled rows of the folders given (not a test): python tests/llm/toxicity_accuracy.py /root/testdata/sf0.1"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from strandline.llm import queries  # noqa: E402
from strandline.runtime import local_session, table  # noqa: E402


def main() -> None:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for d in sys.argv[1:] or ["/root/testdata/sf0.1"]:
        start = time.time()
        rows = queries.op3_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
        hit = sum(r["toxic"] * r["predicted"] for r in rows)
        bad, said = sum(r["toxic"] for r in rows), sum(r["predicted"] for r in rows)
        pairs = sorted((r["score"], r["toxic"]) for r in rows)
        below = wins = 0.0
        for _, y in pairs:
            wins += below if y else 0
            below += 1 - y
        print(f"{d}: {len(rows)} held-out rows, {bad} toxic; precision {hit / max(1, said):.3f}, recall {hit / max(1, bad):.3f}, ordinary rows called toxic {(said - hit) / max(1, len(rows) - bad):.4f}, AUC {wins / max(1, bad * (len(rows) - bad)):.3f}; {time.time() - start:.0f} s")


if __name__ == "__main__":
    main()
