"""The pipeline's stages, each against a plain version on its own input, and on odd tables."""

import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from strandline.llm import queries, toxicity
from tests.llm.test_corpus import edited, greedy_mix, text, truth


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(21)
    rows = []
    for i in range(300):
        lines = [text(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))] + (["This line recurs in very many of the documents here"] if i % 5 == 0 else [])
        if i % 9 == 0:
            lines[0] += " vilex grumbo snarf " + text(rng, 3) + " vilex blotto"
        rows.append((i, "\n".join(lines), "en", f"src{i % 4}", 0, i))
    for k in range(40):
        rows.append((300 + k, rows[k][1] if k % 2 else edited(rng, rows[k][1], 1), "en", "src0", 7, k))
    rows = [(a, t, lang, s, len(t), x) for a, t, lang, s, _, x in rows]
    rows += [(400, None, "en", "src1", None, 1), (401, "", None, None, 0, None), (None, "no id at all", "en", None, 12, 2), (402, text(rng, 40000), "en", "src2", 1, 3), rows[5], rows[5], (403, "   ", None, "src3", 3, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0), 1) for i in range(300)] + [(None, 1, None), (7, None, None), (9999, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def masked(line):
    t = ["<*>" if any(c.isdigit() for c in w) else w for w in line.split()]
    return " ".join(t) if 2 * t.count("<*>") < len(t) else line


def key(r):
    return tuple(r)


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = str(tmp_path / f"{i}.parquet")
        out.write.parquet(path)
        got = Counter(map(key, spark.read.parquet(path).collect())) if name != "bpe" else None
        have = docs.collect()
        if name == "toxicity":
            model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            pair = model.compressors()
            bad = lambda r: model.scores([r["text"]], pair)[0] >= 0.3
            assert got == Counter(key(r) for r in have if not bad(r)) and 20 < len(have) - sum(got.values()) < 60
        elif name == "line_dedup":
            held = defaultdict(list)
            for r in have:
                for k in {masked(x) for x in (r["text"] or "").split("\n") if x.strip()}:
                    held[k].append(r["doc_id"])
            often = {k: min((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= 10}
            want = Counter()
            for r in have:
                lines = (r["text"] or "").split("\n")
                kept = [x for x in lines if masked(x) not in often or r["doc_id"] == often[masked(x)]]
                d = r.asDict()
                if len(kept) < len(lines):
                    d["text"] = "\n".join(kept)
                    d["n_chars"] = len(d["text"])
                    if not d["text"].strip():
                        continue
                want[tuple(d.values())] += 1
            assert got == want and got != Counter(map(key, have))
        elif name == "near_dedup":
            first = {i: c for i, _, c in truth([(r["doc_id"], r["text"]) for r in {key(r): r for r in have}.values()], 5)}
            want = {key(r) for r in have if r["doc_id"] is None or first[r["doc_id"]] == r["doc_id"]}
            assert got == Counter(dict.fromkeys(want, 1)) and len(want) < len(have)
        elif name == "source_mix":
            size, target = greedy_mix([(r["doc_id"], r["text"], r["source"]) for r in have])
            words = Counter()
            for r, n in got.items():
                assert r in set(map(key, have)) and n <= 3 * sum(key(x) == r for x in have)
                words[r[3]] += n * len((r[1] or "").split())
            largest = Counter()
            for r in have:
                largest[r["source"]] = max(largest[r["source"]], len((r["text"] or "").split()))
            assert all(abs(words[x] - target[x]) <= largest[x] / 2 + 1 for x in size)
        else:
            t = Tokenizer.from_file(queries.tokenizer_path())
            want = Counter()
            for r in have:
                ids = t.encode(r["text"] or "", add_special_tokens=False).ids
                want[r["doc_id"], tuple(ids), len(ids), r["text"] or ""] += 1
            assert sorted((r["doc_id"] or -1, tuple(r["ids"]), r["n_tokens"], r["text"]) for r in spark.read.parquet(path).collect()) == sorted((a or -1, b, c, d) for (a, b, c, d), n in want.items() for _ in range(n))
            continue
        docs = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, sf_dir).count() == sum(want.values())


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        assert stage(spark, docs.where("doc_id in (400, 401)"), sf_dir).count() <= 2


def test_stages_with_clashing_names_maps_and_ids_that_repeat(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40 or doc_id is null")
    odd = docs.unionByName(docs.where("doc_id = 5").withColumn("text", F.lit("another text under the same id")))
    odd = odd.withColumn("m", F.create_map(F.lit("k"), F.col("score"))).withColumn("upper", F.lit("x")).toDF(*odd.columns, "m", "TEXT")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in odd.schema]
        same = [tuple(r)[:2] for r in out.collect() if r[0] == 5]
        if name == "near_dedup":
            assert len(same) == 2 and (5, "another text under the same id") in same
