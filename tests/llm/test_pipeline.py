"""The pipeline and the registered queries on small tables."""

import __spark_entry__ as entry
import corpus_pipeline
from llm_helpers import prose

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder):
    texts = [prose(i, 80) + ".\na line shared by all of them" for i in range(60)] + [" ".join(w + "###" for w in prose(i, 80).split()) for i in range(100, 130)]
    bench = prose(7777, 30)
    texts += [prose(3, 80) + ".\na line shared by all of them", "x " + bench, prose(8, 2000) + " " + bench]
    texts += [prose(5000, 3000), prose(5000, 3000) + " tail"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLS
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not set(kept["quality"]) & set(range(60, 90)) and set(range(60)) <= set(kept["quality"])
    shared = [i for i, r in kept["lines"].items() if "shared by all" in r["text"]]
    assert shared == [0] and all(r["n_chars"] == len(r["text"]) for r in kept["lines"].values())
    assert kept["lines"][90]["text"] == ""  # an exact copy has lost its lines
    assert 93 in kept["near_duplicates"] and 94 in kept["lines"] and 94 not in kept["near_duplicates"] and 3 in kept["near_duplicates"]
    assert 91 not in kept["decontamination"] and 92 in kept["decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == set(kept["decontamination"]) and not final.where("NOT round_trip").count()
    assert len(rows) == 95


def test_registered(spark):
    q = entry.queries()
    assert {f"op{i}_" for i in range(1, 14)} == {k.split("_")[0] + "_" for k in q if k.startswith("op")} and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, by the plain functions of the operators' tests."""
    import sentencepiece
    from test_dedup import components_of, contamination_of, first_lines

    from wardline.llm import quality_gam, sentencepiece_trie

    folder = str(tmp_path)
    write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = {}

    def run(name, docs):
        stages[name](spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        out = spark.read.parquet(f"{folder}/out/{name}")
        rows[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
        return out

    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = quality_gam.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    out = run("quality", docs)
    assert sorted(rows["quality"]) == sorted((i, t) for i, t in before if model.score(quality_gam.matrix([t]))[0] >= 0.3)
    out = run("lines", out)
    assert sorted(rows["lines"]) == sorted((i, "\n".join(kept)) for i, kept in first_lines(rows["quality"]))
    out = run("near_duplicates", out)
    names = {c for _, _, c in components_of(rows["lines"])}
    assert sorted(rows["near_duplicates"]) == sorted((i, t) for i, t in rows["lines"] if i in names)
    out = run("decontamination", out)
    assert sorted(rows["decontamination"]) == sorted((i, t) for i, t in rows["near_duplicates"] if not contamination_of(t, bench)[4])
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_trie.model_bytes())
    got = sorted((r["doc_id"], r["ids"], r["round_trip"]) for r in stages["sentencepiece"](spark, out, folder).collect())
    assert got == sorted((i, sp.encode(t), sp.decode(sp.encode(t)) == t) for i, t in rows["decontamination"])
    assert len(before) > len(rows["quality"]) > len(rows["near_duplicates"]) > len(rows["decontamination"]) > 50
