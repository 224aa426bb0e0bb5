"""Token counts of greedy longest-match word pieces, by an automaton that is linear in the text."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.batches import map_batches, raw_texts, row_schema, text_slices

SYMBOLS = 512  # a byte, or 256 more for the last byte of a word
#: Bytes that the words whose pieces an automaton has counted may take before it forgets them.
KNOWN_BYTES = 48 << 20
END = "</w>"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_names() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies name bytes: printable Latin-1 stands for itself, the
    others for the characters from U+0100 on in ascending order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_pieces(tokenizer_json: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary with word ends as symbols; special tokens are left out."""
    data = json.loads(tokenizer_json)
    special = {t["content"] for t in data.get("added_tokens", []) if t.get("special")}
    names = byte_names()
    pieces = []
    for token in data["model"]["vocab"]:
        if token in special:
            continue
        last = token.endswith(END) and token != END
        symbols = [names[c] for c in (token[: -len(END)] if last else token)]
        if last:
            symbols[-1] += 256
        pieces.append(tuple(symbols))
    return pieces


def word_symbols(word: bytes) -> tuple[int, ...]:
    return (*word[:-1], word[-1] + 256)


@dataclass
class Automaton:
    """A vocabulary trie with failure links. ``popped[node]`` is how many pieces the greedy segmentation has finished when
    a node's string can't go on as one piece, and ``fail[node]`` the node of what is then left of it."""

    edges: dict[int, int]  # node * SYMBOLS + symbol -> node
    fail: list[int]
    popped: list[int]
    known: dict[bytes, int] = field(default_factory=dict)
    known_bytes: int = 0

    @classmethod
    def of(cls, pieces: list[tuple[int, ...]]) -> Automaton:
        """Every single symbol has to be a piece, so that each word has a segmentation."""
        edges: dict[int, int] = {}
        parent, symbol, ends = [-1], [-1], [False]
        for piece in pieces:
            node = 0
            for s in piece:
                child = edges.get(node * SYMBOLS + s)
                if child is None:
                    child = edges[node * SYMBOLS + s] = len(parent)
                    parent.append(node)
                    symbol.append(s)
                    ends.append(False)
                node = child
            ends[node] = node != 0
        if any(not ends[edges.get(s, 0)] for s in range(SYMBOLS)):
            raise ValueError("the vocabulary lacks a single symbol")
        children: list[list[int]] = [[] for _ in parent]
        for node in range(1, len(parent)):
            children[parent[node]].append(node)
        fail, popped = [0] * len(parent), [0] * len(parent)
        todo = deque(children[0])
        while todo:
            node = todo.popleft()
            todo.extend(children[node])
            if ends[node]:
                popped[node] = 1  # the piece itself; nothing is left
                continue
            at, n, s = fail[parent[node]], popped[parent[node]], symbol[node]
            while (to := edges.get(at * SYMBOLS + s)) is None:
                n += popped[at]
                at = fail[at]
            fail[node], popped[node] = to, n
        return cls(edges, fail, popped)

    def count(self, word: bytes) -> int:
        """Pieces of a word that is not empty."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = n = 0
        last = len(word) - 1
        for i, s in enumerate(word):
            if i == last:
                s += 256
            while (to := edges.get(node * SYMBOLS + s)) is None:
                n += popped[node]
                node = fail[node]
            node = to
        while node:
            n += popped[node]
            node = fail[node]
        return n

    def counts(self, words: list[bytes]) -> list[int]:
        known = self.known
        if self.known_bytes > KNOWN_BYTES:
            known.clear()
            self.known_bytes = 0
        for word in set(words).difference(known):
            known[word] = self.count(word)
            self.known_bytes += len(word) + 130  # with its place in the table
        return [known[w] for w in words]


def count_pieces(docs: DataFrame, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(<doc_id>, n_bytes, n_words, n_tokens, most_in_word)``, one for each row of ``docs``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. A word's pieces are taken greedily: from left to right
    the longest piece of the vocabulary (a tokenizer file with byte-level pieces and ``</w>`` for word ends). The
    automaton counts them in one walk over the bytes, whatever the pieces' lengths, and no piece is built.

    A null or empty text, or one of white space, has 0 in all counts but its bytes. Repeated rows give repeated results, an
    empty table no rows; columns other than the two named are not looked at. Texts are counted whole.
    """
    automaton = Automaton.of(vocabulary_pieces(tokenizer_json))
    shared = docs.sparkSession.sparkContext.broadcast(
        (
            np.array([*automaton.edges.keys()], np.int32),
            np.array([*automaton.edges.values()], np.int32),
            np.array(automaton.fail, np.int32),
            np.array(automaton.popped, np.int32),
        )
    )  # as large as the vocabulary file
    schema = row_schema(docs, doc_id, "n_bytes long, n_words long, n_tokens long, most_in_word long")

    def run(batches):
        keys, nodes, fail, popped = shared.value
        own = Automaton(dict(zip(keys.tolist(), nodes.tolist(), strict=True)), fail.tolist(), popped.tolist())
        for part in text_slices(batches):
            rows = []
            for body in raw_texts(part.column("text")):
                counts = own.counts(body.translate(_FOLD).split())
                rows.append((len(body), len(counts), sum(counts), max(counts, default=0)))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, columns)], names=schema.names)

    return map_batches(docs.select(docs[doc_id].alias("key"), docs[text].alias("text")), run, schema)
