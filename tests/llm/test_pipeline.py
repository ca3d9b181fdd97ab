from collections import Counter

import corpus_pipeline

from spanloom.llm import decontaminate


def test_stages(spark):
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from spanloom.llm import common

        kept = common.staged(stage(spark, docs, where), name)
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
        assert kept.select("doc_id").distinct().count() == kept.count()
        seen[name], docs = kept, kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].select("doc_id").collect()}
    assert sum(labels[i] for i in labels if i in kept) / sum(i in kept for i in labels) > 0.98 and sum(i in kept for i in labels if labels[i]) / sum(labels.values()) > 0.98
    norm = [r[0] for r in seen["exact_dedup"].selectExpr(r"regexp_replace(text, '[\\x20\\x09-\\x0D]+', '')").collect()]
    assert len(norm) == len(set(norm))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in seen["near_dedup"].select("text").collect() for w in [r.text.lower().split()]]
    where_is = {}
    for k, g in enumerate(grams):
        for x in g:
            where_is.setdefault(x, []).append(k)
    close = {(a, b) for at in where_is.values() if len(at) < 50 for a in at for b in at if a < b}
    assert not [1 for a, b in close if len(grams[a] & grams[b]) >= 0.9 * len(grams[a] | grams[b])]
    out = corpus_pipeline.encoding_stage(spark, docs, where)
    assert out.count() == docs.count() and {"doc_id", "token_ids"} <= set(out.columns)


def test_empty_tables(spark, tmp_path):
    where = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def exact_components(texts):
    """The smallest row of each row's component over counted five-word shingles with a similarity of at least 0.8; every pair that shares one is looked at."""
    words = ["".join(c.lower() if c.isascii() else c for c in t).encode().split() for t in texts]
    grams = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    where, label = {}, list(range(len(texts)))
    for k, g in enumerate(grams):
        met = {j for x in g for j in where.get(x, ())} | ({j for j in range(k) if not grams[j]} if not g else set())
        for j in met:
            if label[j] != label[k] and (not g or 5 * (shared := sum((g & grams[j]).values())) >= 4 * (g.total() + grams[j].total() - shared)):
                low, high = sorted((label[j], label[k]))
                label = [low if x == high else x for x in label]
        for x in g:
            where.setdefault(x, []).append(k)
    return label


def test_near_dedup_stage_keeps_one_of_each_exact_component(spark):
    where = "/root/testdata/sf0.01"
    docs = corpus_pipeline.exact_dedup_stage(spark, spark.read.parquet(f"{where}/documents.parquet"), where)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    # planted: copies of whole documents between 0.6 and 0.95, every fifth word changed at a spot that a fixed step finds
    base = [r for r in rows if 100 <= len(r[1].split()) <= 400][:40]
    for n, (i, text) in enumerate(base):
        words = text.split()
        for k in range(max(1, round(len(words) * (0.006 + 0.0012 * n)))):
            words[(k * 37 + 11) % len(words)] = f"planted{n}x{k}"
        rows.append((10**9 + i, " ".join(words)))
    label = exact_components([t for _, t in rows])
    schema = docs.schema
    fixed = spark.createDataFrame([tuple(i if f.name == "doc_id" else t if f.name == "text" else None for f in schema) for i, t in rows], schema)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, fixed, where).select("doc_id").collect()}
    assert kept == {rows[x][0] for x in label} and 0 < sum(i >= 10**9 for i in kept) < len(base)


def test_decontamination_stage_against_sql(spark):
    import duckdb

    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{where}/{name}.parquet')")
    leaks = {r[0] for r in con.execute(f"select doc_id from ({decontaminate.OP10_SQL})").fetchall()}
    kept = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, where).select("doc_id").collect()}
    assert leaks and kept == {r.doc_id for r in docs.select("doc_id").collect()} - leaks
