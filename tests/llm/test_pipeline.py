"""The corpus pipeline: each stage against brute force, on odd tables too, and all together."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import compression_quality, mixing, quality_rules, queries
from tests.llm.test_operators import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, copy string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small documents with nulls, repeats, near copies, a hot source and columns named like the operators' own."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 90").withColumns({"kept": F.lit("own"), "copy": F.lit("mine")})
    rows = [tuple(r) for r in docs.collect()]
    text = max((r[1] for r in rows), key=lambda t: len(set(t.split())))
    near = text + " one more"
    odd = [(None, text, "en", "src0", 1, "own", "mine"), (None, near, "en", None, 1, "own", "mine"), (5000, near, "en", "src0", 1, "own", "mine"), (5001, None, None, None, None, "own", "mine"), (5002, "", "en", "src0", 0, "own", "mine"), (None, None, None, None, None, "own", "mine")]
    spark.createDataFrame(rows + odd + rows[:5] + odd[:1], COLUMNS).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def plain(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


def sql(con_rows, query):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in con_rows])
    return con.execute(query).fetchall()


def brute(stage, rows, model=None):
    """What a stage returns for plain rows."""
    if stage == "quality rules":
        good = {}
        for r, text in zip(rows, [r[1] for r in rows]):
            if text not in good:
                good[text] = sql([(0, text, "", "", 0)], f"SELECT kept FROM ({quality_rules.sql()})")[0][0]
        return [r for r in rows if good[r[1]]]
    if stage == "quality classifier":
        sizes = compression_quality._Sizes(model.good, model.bad, model.level)
        return [r for r in rows if compression_quality.probability(sizes.features(r[1]), model.weights) >= corpus_pipeline.LEAST_QUALITY]
    if stage == "n-gram Jaccard join":
        texts = sorted({r[1] for r in rows if r[0] is None}, key=str)
        keyed = [(r[0] if r[0] is not None else 10**6 + texts.index(r[1]), r) for r in rows]
        comp = brute_components([(k, r[1]) for k, r in keyed], 5, 80, 100)
        heads = {k for k, _, least, _ in comp if k == least}
        return list({(k, r[1]): r for k, r in keyed if k in heads}.values())
    if stage == "mixing to target weights":
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(r[0], str(i), r[2], r[3], r[4]) for i, r in enumerate(rows)])
        return [rows[int(i)] for (i,) in con.execute(f"SELECT text FROM ({mixing.SQL})").fetchall()]
    import tiktoken

    path, pattern = queries.vocabulary()
    from strandline.llm import bpe

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    ids = [own.encode_ordinary(r[1] or "") for r in rows]
    return [(r[0], r[3], len(i), b"".join(x.to_bytes(4, "little") for x in i), True) for r, i in zip(rows, ids)]


def learned(spark, d):
    from strandline.llm.common import fold, table

    labels = table(spark, d, "labels").filter(fold("doc_id", 5) != 0)
    return compression_quality.fit(compression_quality.labelled_sample(table(spark, d, "documents"), labels, "quality", queries.QUALITY_PER_CLASS))


def test_stages_and_run_against_brute_force(spark, tables):
    model = learned(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = plain(docs)
    went = 0
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        want = sorted(brute(name, rows, model), key=repr)
        got = plain(out)
        if name == "n-gram Jaccard join":
            # of rows that repeat an id and text any may stay
            assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(((r[0], r[1]) for r in want), key=repr) and set(got) <= set(rows)
        else:
            assert got == want, name
        if i < 4:
            assert out.columns == docs.columns
            went += len(rows) - len(got)
            docs = spark.createDataFrame(got, COLUMNS)
            rows = got
    assert went > 0 and all(r[-1] for r in got)
    assert sorted(plain(corpus_pipeline.run(spark, tables)), key=repr) == got


def test_stages_on_the_odd_rows(spark, tables):
    """Each stage on the whole table by itself, nulls and repeats among it."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model, rows = learned(spark, tables), plain(docs)
    for name, stage in corpus_pipeline.STAGES:
        got, want = plain(stage(spark, docs, tables)), sorted(brute(name, rows, model), key=repr)
        if name == "n-gram Jaccard join":
            got, want = (sorted(((r[0], r[1]) for r in x), key=repr) for x in (got, want))
        assert got == want, name


def test_stages_on_no_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0 and (name == "byte-level BPE" or out.columns == docs.columns)


def test_near_copies_where_partitions_hold_equal_texts(spark, tables):
    """Tables repeated with shifted keys, and partitions of one text each: batches of sets are equal."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 12").orderBy("doc_id").select("text").collect()]
    texts.append(texts[0] + " one more")
    for part, copies in ((texts, 4), (texts[:1], 6)):
        rows = [(100 * k + i, t, "en", "src0", len(t), "own", "mine") for k in range(copies) for i, t in enumerate(part)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, copies), COLUMNS)
        assert plain(corpus_pipeline.without_near_copies(spark, docs, tables)) == sorted(brute("n-gram Jaccard join", rows), key=repr)
