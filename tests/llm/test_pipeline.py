import corpus_pipeline as P
from lodestone.llm.queries import tokenizer_file

from .test_decontaminate import brute as contaminated
from .test_near_dedup import brute as components

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    """Each stage's decisions by brute force on what the stage before kept."""
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in P.identify_language(spark, docs, SF).collect()}
    assert len(rows) >= 0.95 * docs.count()
    least = {i: c for i, _, c in components(list(rows.items()), percent=80)}
    rows = {i: t for i, t in rows.items() if least[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = contaminated(list(rows.values()), items)
    rows = {i: t for (i, t), (_, own, _) in zip(rows.items(), hit, strict=True) if not own}
    library = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: (r.ids, r.decoded) for r in P.run(spark, SF).collect()}
    assert got == {i: (library.encode(t), library.decode(library.encode(t))) for i, t in rows.items()}


def test_stages_take_awkward_and_empty_tables(spark, awkward, none_at_all):
    docs = awkward.selectExpr("doc_id", "text", "lang", "source", "length(text) n_chars")
    for table in (docs, docs.filter("false")):
        for number, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, table, SF)
            assert out.count() <= table.count()
            if number + 1 < len(P.STAGES):
                assert out.columns == table.columns


def test_stage_links_from_four_fifths_on(spark):
    """A pair with a similarity between 0.80 and 0.85 is linked, one below isn't."""
    base = [f"w{i}" for i in range(100)]
    # n words added to 96 shingles: similarities of 96/96+n
    documents = [(10 * g + k, " ".join([f"g{g}", *base, *(f"x{g}.{i}" for i in range(k * n))])) for g, n in enumerate([20, 24, 25, 30]) for k in (0, 1)]
    documents = [(i, " ".join(w if w[0] in "gx" else f"{i // 10}{w}" for w in t.split())) for i, t in documents]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    kept = {r.doc_id for r in P.remove_near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, _, c in components(documents, percent=80) if i == c} != {i for i, _, c in components(documents) if i == c}


def test_bands_follow_the_limit():
    from lodestone.llm.near_dedup import bands_for

    assert (bands_for(85), bands_for(80), bands_for(100)) == (25, 37, 1)
