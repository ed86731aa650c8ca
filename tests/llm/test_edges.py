"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallytree.llm import decontaminate, language, pieces, quality, repetition, rollups, simhash, suffixes, toxicity, training_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, h long, t long, y int, found string, __id long, __t long, __bad long, __h long, __fp long, __text string, id long, _id string, d long, print int, hash long, spans string, place int"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all the others. "
TEXTS = [None, "", " \n\t", "a", PROSE * 3, PROSE * 3, "ein zwei drei vier fünf\nein zwei drei vier fünf\n☃ 北京 ²", "x" * 5000, "word " * 40_000, PROSE + "you worthless idiot!", "123 456", "<<<### $$$", "İstanbul ſ K"]

#: Values of columns with names that stages could use for themselves.
MORE = (1, 2, 3, 4, 5, "t", 6, "_", 7, 8, 9, "s", 10)


def rows():
    out = [(k, t, ["en", "de", None][k % 3], ["s1", None][k % 2], len(t) if t is not None else None, 0.5, "x", 1, 2, 3, "z", *MORE) for k, t in enumerate(TEXTS)]
    return [*out, out[4], (None, PROSE, "en", "s1", 0, 0.0, "", 0, 0, 0, "", *MORE), (4, "another text with the id of some other row", "en", "s1", 0, 0.0, "", 0, 0, 0, "", *MORE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2, 1) for k in range(14)] + [(3, None, None, 1), (None, 1, 1, 1), (5, 7, 7, 1), (4, 1, 0, 1)], "doc_id long, quality int, toxic int, text int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "brown fox jumps", 1), (2, None, 1), (3, "!!!", 1), (None, "dog", 1), (4, "b " * 30, 1)], "item_id long, text string, doc_id int")


N = len(TEXTS) + 3
OPERATORS = {
    "suffixes": lambda d, **_: suffixes.suffix_dedup(d),
    "quality": lambda d, labels, **_: quality.quality_scores(d, quality.train(d, labels)),
    "decontaminate": lambda d, benchmark, **_: decontaminate.contamination(d, benchmark),
    "decontaminate_blocks": lambda d, benchmark, **_: decontaminate.contamination(d, benchmark, block_words=2),
    "toxicity": lambda d, labels, **_: toxicity.toxicity_scores(d, toxicity.train(d, labels)),
    "language": lambda d, **_: language.language_scores(d, language.train(d)),
    "pieces": lambda d, **_: pieces.digests(d),
    "simhash": lambda d, **_: simhash.near_duplicates(d),
    "repetition": lambda d, **_: repetition.quality_rules(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, empty, labels, benchmark, name):
    f = OPERATORS[name]
    got = f(docs, labels=labels, benchmark=benchmark)
    found = got.collect()
    assert len(found) == N
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found) == sorted(-1 if r[0] is None else r[0] for r in rows())
    assert not any(v is None for r in found for k, v in r.asDict().items() if k not in ("doc_id", "component_id"))
    none = f(empty, labels=labels, benchmark=benchmark)
    assert none.collect() == [] and none.schema == got.schema
    for nothing in ({"labels": labels.limit(0), "benchmark": benchmark.limit(0)},):
        assert f(docs, **nothing).count() == N


def test_defined_values(docs, labels, benchmark):
    by = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id not in (4, None)}
    words = by(repetition.quality_rules(docs))
    assert words[0].base_failed and words[0].n_words == 0 and not words[8].kept
    assert words[6].n_dup_lines == 1 and words[11].n_symbols == 9
    prints = by(simhash.near_duplicates(docs))
    assert {prints[k].fingerprint for k in (0, 1, 2)} == {"0" * 16} and {prints[k].component_id for k in (0, 1, 2)} == {0}
    langs = by(language.language_scores(docs, language.train(docs)))
    assert {langs[k].lang_pred for k in (0, 1, 2, 10, 11)} == {"und"} and langs[0].score == 0
    assert by(pieces.digests(docs))[6].round_trip and by(pieces.digests(docs))[0].n_pieces == 0
    hit = by(decontaminate.contamination(docs, benchmark))
    assert hit[9].n_items == 1 and hit[9].n_hit == 3 and hit[0].n_words == 0 and not hit[0].contaminated
    assert by(suffixes.suffix_dedup(docs))[7].n_removed == 5000  # equal 400-byte strings that overlap


def test_training_order(spark, docs, empty, tmp_path):
    out = f"file://{tmp_path}/a"
    got = training_order.materialise(docs, out, length=16, shard_bytes=4096).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sum(1 for r in got if r.doc_id == 0) == 1
    again = training_order.materialise(docs, f"file://{tmp_path}/b", length=16, shard_bytes=4096).collect()
    key = lambda r: (r.slot, r.crc32)
    assert sorted(map(key, got)) == sorted(map(key, again))
    shuffled = training_order.materialise(docs.repartition(3, "n_chars"), f"file://{tmp_path}/c", length=16).collect()
    assert sorted(r.crc32 for r in shuffled) == sorted(r.crc32 for r in got)
    assert training_order.materialise(empty, f"file://{tmp_path}/d").collect() == []
    total = len(got)
    everything = list(training_order.read(spark, out, 0, total, length=16))
    part = list(training_order.read(spark, out, 7, 30, length=16))
    assert len(everything) == total and all((a == b).all() for a, b in zip(part, everything[7:37], strict=True))


def test_rollups(spark, docs, empty, tmp_path):
    counts = rollups.counted(docs, "v")
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == []
    assert r.commit(rollups.inserts(counts, F.lit(0))) == [0]
    before = sorted(map(tuple, r.totals().collect()), key=repr)
    assert r.commit(rollups.inserts(counts, F.lit(0))) == []
    assert sorted(map(tuple, r.totals().collect()), key=repr) == before
    assert sum(x[3] for x in before) == N and (None in {x[0] for x in before})
    assert r.commit(rollups.revisions(counts, F.lit(1), F.col("n_tokens"), F.col("n_tokens") + 1)) == [1]
    assert sum(x.n_tokens for x in r.totals().collect()) == sum(x[4] for x in before) + N
    gone = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    r.commit(rollups.deletes(gone, F.lit(2)))
    assert r.totals().collect() == []
    assert r.commit(rollups.inserts(rollups.counted(empty, "v"), F.lit(3))) == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, docs, empty, labels, benchmark, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    found = got.collect()
    assert 0 < len(found) <= N
    assert stage(spark, empty, str(tmp_path)).collect() == []
    if name == "simhash_near_dedup":
        kept = simhash.near_duplicates(got).collect()
        assert len({(r.component_id, r.fingerprint) for r in kept}) == len(kept)  # two groups may have the repeated id
        assert sum(1 for r in found if r.text and r.text.startswith(PROSE * 3)) == 1
    if name == "benchmark_decontamination":
        assert 9 not in {r.doc_id for r in found}


def test_names_of_a_stage_with_a_benchmark_in_blocks(docs, benchmark):
    got = decontaminate.drop_contaminated(docs, benchmark, block_words=2)
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, decontaminate.drop_contaminated(docs, benchmark).collect()))


def test_a_text_of_tens_of_megabytes(spark, labels, benchmark):
    """One row of 24 MB beside a small one: whole results, in bounded memory."""
    long = (PROSE * 6 + "".join(f"w{k % 977} " for k in range(250))) * 14_000
    long = long[: 24 << 20]
    two = spark.createDataFrame([(1, long, "en", "s"), (2, PROSE, "en", "s")], "doc_id long, text string, lang string, source string")
    cut = {r.doc_id: r for r in suffixes.suffix_dedup(two).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}
    assert cut[1].n_bytes == len(long) and cut[1].n_removed == len(long) and cut[1].n_spans == 1 and cut[2].n_removed == 0
    rules = {r.doc_id: r for r in repetition.quality_rules(two).collect()}
    assert rules[1].n_repeat_words == rules[1].n_words == len(long.split()) and rules[1].base_failed
    hit = {r.doc_id: r for r in decontaminate.contamination(two, benchmark).collect()}
    assert hit[1].n_hit == 3 * long.count("brown fox jumps") and hit[1].contaminated == (20 * hit[1].n_hit >= hit[1].n_words)
    assert simhash.near_duplicates(two).count() == 2
    assert {r.doc_id: r.n_words for r in language.language_scores(two, language.train(two)).collect()}[1] > 1_000_000


def test_last_stage(spark, docs, empty):
    got = corpus_pipeline.sentencepiece_encoding(spark, docs, "")
    texts = {(r.doc_id, r.text) for r in pieces.decode(got).collect()}
    assert texts == {(r[0], r[1] or "") for r in rows()}
    assert corpus_pipeline.sentencepiece_encoding(spark, empty, "").collect() == []


def test_last_stage_gives_the_n_best(spark, docs):
    v, found = pieces.pieces(), corpus_pipeline.sentencepiece_encoding(spark, docs, "").collect()
    key = lambda x: (-1 if x[0] is None else x[0], len(x[1]), x[1])
    got = sorted(((r.doc_id, r.ids, r.score, [(o.ids, o.score) for o in r.others]) for r in found), key=key)
    want = []
    for r in rows():
        (ids, score), *others = [(i.tolist(), s) for i, s in v.encode(r[1] or "", pieces.BEST)]
        want.append((r[0], ids, score, others))
    assert got == sorted(want, key=key) and max(len(x[3]) for x in got) == pieces.BEST - 1
