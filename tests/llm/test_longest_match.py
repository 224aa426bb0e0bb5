import random

from lodestone.llm import longest_match as M
from lodestone.llm.queries import op5_longest_match

from .conftest import space_words

SF = "/root/testdata/sf0.001"


def greedy(symbols, pieces, longest):
    n = at = 0
    while at < len(symbols):
        at += next(size for size in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + size] in pieces)
        n += 1
    return n


def test_automaton_against_greedy_search():
    rng = random.Random(4)
    single = [(s,) for s in range(M.SYMBOLS)]
    for _ in range(30):
        more = [tuple([rng.choice([97, 98]) for _ in range(rng.randint(1, 5))] + [rng.choice([97, 98, 97 + 256, 98 + 256])]) for _ in range(25)]
        pieces = set(single) | set(more)
        automaton = M.Automaton.of([*single, *more])
        for _ in range(60):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == greedy(M.word_symbols(word), pieces, 7)


def test_query_against_greedy_search(spark, tokenizer_path):
    with open(tokenizer_path("word_bpe_49k.json")) as file:
        pieces = set(M.vocabulary_pieces(file.read()))
    longest = max(map(len, pieces))
    known = {}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op5_longest_match(spark, SF).collect():
        words = [w.encode() for w in space_words(docs[r.doc_id])]
        for w in words:
            if w not in known:
                known[w] = greedy(M.word_symbols(w), pieces, longest)
        counts = [known[w] for w in words]
        assert (r.n_words, r.n_tokens, r.most_in_word) == (len(words), sum(counts), max(counts, default=0))


def test_awkward_rows(spark, awkward, none_at_all, tokenizer_path):
    with open(tokenizer_path("word_bpe_49k.json")) as file:
        source = file.read()
    rows = M.count_pieces(awkward, source).collect()
    assert len(rows) == awkward.count()
    empty = [r for r in rows if r.n_words == 0]
    assert len(empty) == 4 and all(r.n_tokens == r.most_in_word == 0 for r in empty)
    assert all(r.n_tokens >= r.n_words for r in rows)
    assert M.count_pieces(none_at_all, source).collect() == []
