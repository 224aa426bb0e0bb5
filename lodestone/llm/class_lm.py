"""A class-based bigram language model with classes from exchange clustering, and scores of texts under it."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.batches import list_column, map_batches, raw_texts, text_slices
from lodestone.materialize import materialize

#: Most words whose counts every task holds; the counts of all others are joined.
HEAD_WORDS = 200_000
#: The core: the most frequent words, which exchange clustering assigns to classes on the driver.
CLUSTERED, CLASSES = 2_048, 96
EXCHANGE_ROUNDS = 6
#: Every further word that occurs so often joins the core's class that suits its neighbours best; rarer ones have a class by their shape.
LEARNED_FROM = 5
#: Contexts (or pairs) that a task holds before it hands them on, and further words whose classes are tried at once.
HELD_CONTEXTS, TRIED_WORDS = 1 << 21, 256
#: Added to a word's count, and the weight of the classes' own frequencies beside a class's successors.
WORD_PRIOR, CLASS_PRIOR = 0.1, 5.0
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 300_000

#: Two classes or numbers of words in one: the left one times this.
_SIDE = 1 << 31
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b""  # the token after a text's last word; no word is empty
SHAPES = 20


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered."""
    return text.translate(_FOLD).split()


def shape_of(word: bytes) -> int:
    """A class of words that needs no counts: by the kind of the last byte, other bytes than ASCII, and length."""
    last = word[-1]
    if last >= 0x80:
        kind = 4
    elif 97 <= last <= 122:
        kind = 0
    elif 48 <= last <= 57:
        kind = 1
    elif last in b".,":
        kind = 2
    else:
        kind = 3
    return kind * 4 + (not word.isascii()) * 2 + (len(word) > 9)


_KINDS = np.array([shape_of(bytes([b])) // 4 for b in range(256)])


def shapes_of(words: pa.Array) -> np.ndarray:
    """``shape_of`` for all words of an array, none of them empty."""
    if not len(words):
        return np.empty(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]]
    wide = np.append(0, np.cumsum(raw >= 0x80))
    return _KINDS[raw[ends[1:] - 1]] * 4 + (wide[ends[1:]] > wide[ends[:-1]]) * 2 + (np.diff(ends) > 9)


class Numbers:
    """Numbers of words: those of the given words and, after them, of others in the order in which they are met, with their shapes."""

    def __init__(self, given: list[bytes]) -> None:
        self.known, self.given = dict(zip(given, range(len(given)), strict=True)), len(given)
        self.forget_others()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    @property
    def n_others(self) -> int:
        return len(self.number) - self.given

    def shapes_of_others(self) -> np.ndarray:
        if len(self._shapes) < self.n_others:
            new = pa.array(list(islice(self.number, self.given + len(self._shapes), None)), pa.binary())
            self._shapes = np.append(self._shapes, shapes_of(new))
        return self._shapes

    def others(self) -> pa.Array:
        return pa.array(list(islice(self.number, self.given, None)), pa.binary())

    def forget_others(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count(self.given).__next__, self.known)
        self._shapes = np.empty(0, np.int64)


def _tokens(texts: list[bytes]) -> list[bytes]:
    """The tokens of texts one after another, with an end before, between and after them."""
    every = [END]
    for text in texts:
        every += words_of(text)
        every.append(END)
    return every


def learnable(doc_id: Column) -> Column:
    """Documents that may be learned from; the others are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) != 0, F.lit(False))


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(word, n)`` for all tokens of ``train``; the end token is the empty word. Tasks sum up before the shuffle."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        for part in text_slices(batches):
            for body in raw_texts(part.column("text")):
                counts.update(words_of(body))
            counts[END] += part.num_rows
            if len(counts) > COUNTED_WORDS:
                yield rows()
                counts.clear()
        yield rows()

    partial = map_batches(train.select(F.col(text).alias("text")), run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """What stands for words in the transitions: each clustered word, the end, and a shape for every other word."""

    clustered: list[bytes]

    @property
    def end(self) -> int:
        return len(self.clustered)

    @property
    def count(self) -> int:
        return len(self.clustered) + 1 + SHAPES


def count_transitions(train: DataFrame, symbols: Symbols, text: str = "text") -> np.ndarray:
    """How often each symbol follows each other one; the end goes before a text's first word too. The matrix is bounded by the
    number of symbols; tasks sum up their own before the shuffle."""
    shared = train.sparkSession.sparkContext.broadcast(symbols)
    n = symbols.count

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = dict(zip([*own.clustered, END], range(own.end + 1), strict=True))
        counts = np.zeros(n * n, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=n * n)
            held.clear()

        for part in text_slices(batches):
            every = _tokens(raw_texts(part.column("text")))
            ids = np.fromiter(map(known.get, every, repeat(-1)), np.int64, len(every))
            other = np.flatnonzero(ids < 0)
            ids[other] = own.end + 1 + shapes_of(pa.array([every[i] for i in other.tolist()], pa.binary()))
            held.append(ids[:-1] * n + ids[1:])
            if sum(map(len, held)) > HELD_CONTEXTS:
                add()
        add()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pair", "n"])

    partial = map_batches(train.select(F.col(text).alias("text")), run, "pair long, n long")
    counts = np.zeros(n * n, np.int64)
    summed = partial.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most n * n rows
    counts[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return counts.reshape(n, n)


def _symbols(ids: np.ndarray, numbers: Numbers) -> np.ndarray:
    """The symbols of tokens by their numbers, the clustered words and the end being the given ones."""
    return np.append(np.arange(numbers.given), numbers.given + numbers.shapes_of_others())[ids]


def count_contexts(train: DataFrame, symbols: Symbols, classes: np.ndarray, text: str = "text") -> DataFrame:
    """Rows ``(word, codes, times)`` for all words besides the clustered ones: how often a class stands before the word (the code is the class) or
    after it (the class plus the number of classes). A word has a row from each task, or several."""
    shared = train.sparkSession.sparkContext.broadcast((symbols, classes))
    size = int(classes.max()) + 1

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, of = shared.value
        numbers = Numbers([*own.clustered, END])
        held: list[np.ndarray] = []
        waiting = 0

        def rows():
            keys, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            word, codes = np.divmod(keys, 2 * size)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(first, append=len(word))
            return pa.RecordBatch.from_arrays(
                [numbers.others().take(pa.array(word[first] - numbers.given)), list_column(codes.astype(np.int32), sizes), list_column(n, sizes)],
                names=["word", "codes", "times"],
            )

        for part in text_slices(batches):
            ids = numbers.of(_tokens(raw_texts(part.column("text"))))
            beside = of[_symbols(ids, numbers)]
            at = np.flatnonzero(ids >= numbers.given)
            word = ids[at] * (2 * size)
            held += [word + beside[at - 1], word + size + beside[at + 1]]
            waiting += 2 * len(at)
            if waiting > HELD_CONTEXTS or numbers.n_others > COUNTED_WORDS:
                yield rows()
                numbers.forget_others()
                held.clear()
                waiting = 0
        yield rows()

    return map_batches(train.select(F.col(text).alias("text")), run, "word binary, codes array<int>, times array<long>")


def learn_classes(contexts: DataFrame, pairs: np.ndarray, classes: int) -> DataFrame:
    """Rows ``(word, cls)`` for the words with ``LEARNED_FROM`` occurrences: that of the first ``classes`` classes with which the likelihood of
    the class bigrams gains most by the word's own neighbours. ``pairs`` are the bigrams of all classes; a word has at most two contexts for each.

    The rows of a word come one after another in a task, which sums them up as they come and so holds the sums of ``TRIED_WORDS`` words and one batch."""
    size = len(pairs)
    shared = contexts.sparkSession.sparkContext.broadcast(pairs.astype(np.float64))

    def run(batches) -> Iterator[pa.RecordBatch]:
        bigrams = shared.value
        # rows by context: what each class has before and after it
        table = np.concatenate([bigrams[:, :classes], bigrams[:classes].T])
        left, right = bigrams.sum(axis=1)[:classes], bigrams.sum(axis=0)[:classes]
        x_log_x = lambda x: x * np.log(np.maximum(x, 1))

        def best(words: pa.Array, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            total = sums[:, size:].sum(axis=1)
            tried = np.flatnonzero(total >= LEARNED_FROM)
            if not len(tried):
                return
            at, codes = np.nonzero(sums[tried])
            times = sums[tried[at], codes][:, None]
            there = table[codes]
            gain = np.add.reduceat(x_log_x(there + times) - x_log_x(there), np.searchsorted(at, np.arange(len(tried))), axis=0)
            n = total[tried][:, None]
            gain -= x_log_x(left + n) - x_log_x(left) + x_log_x(right + n) - x_log_x(right)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(tried)), pa.array(gain.argmax(axis=1).astype(np.int32))], names=["word", "cls"])

        # the last word may go on in the next batch
        last, last_sums = pa.array([], pa.binary()), np.zeros((0, 2 * size))
        for batch in batches:
            if not batch.num_rows:
                continue
            word = pa.concat_arrays([last, batch.column("word")])
            new = np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False).astype(bool))
            group = np.cumsum(new) - 1
            words, of_row = word.take(pa.array(np.flatnonzero(new))), group[len(last) :]
            codes, times = (batch.column(c).flatten().to_numpy() for c in ("codes", "times"))
            of = np.repeat(of_row, batch.column("codes").value_lengths().to_numpy())
            for start in range(0, len(words), TRIED_WORDS):
                stop = min(start + TRIED_WORDS, len(words))
                a, b = np.searchsorted(of, [start, stop])
                sums = np.bincount((of[a:b] - start) * (2 * size) + codes[a:b], times[a:b], (stop - start) * 2 * size).reshape(-1, 2 * size)
                if not start and len(last):
                    sums[0] += last_sums[0]
                whole = stop - start - (stop == len(words))
                yield from best(words.slice(start, whole), sums[:whole])
                last_seen = sums[whole:]
            last, last_sums = words.slice(len(words) - 1), last_seen
        yield from best(last, last_sums)

    return map_batches(contexts.repartition("word").sortWithinPartitions("word"), run, "word binary, cls int")


def count_class_pairs(train: DataFrame, words: list[bytes], classes: np.ndarray, end: int, shapes: np.ndarray, size: int, rest: DataFrame, text: str = "text") -> np.ndarray:
    """How often each class follows each other one. ``classes`` are those of ``words``, which every task holds; pairs with another word are joined
    with ``rest(word, cls)``, and have the class of its shape if it has none there."""
    shared = train.sparkSession.sparkContext.broadcast((words, classes))

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, of = shared.value
        numbers = Numbers([*own, END])
        of = np.append(of, end)
        counts = np.zeros(size * size, np.int64)
        held: list[np.ndarray] = []
        waiting = 0

        def rows():
            # a word without a known class stands in a pair by its number above the classes
            keys, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            others, own_shapes = numbers.others(), shapes[numbers.shapes_of_others()]
            columns = []
            for side in np.divmod(keys, _SIDE):
                word = side - size
                columns.append(others.take(pa.array(word, mask=word < 0)))
                columns.append(pa.array(np.append(np.arange(size), own_shapes)[side].astype(np.int32)))
            return pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=["left_word", "left", "right_word", "right", "n"])

        for part in text_slices(batches):
            ids = numbers.of(_tokens(raw_texts(part.column("text"))))
            side = np.append(of, size + np.arange(numbers.n_others))[ids]
            sure = (side[:-1] < size) & (side[1:] < size)
            counts += np.bincount(side[:-1][sure] * size + side[1:][sure], minlength=size * size)
            held.append(side[:-1][~sure] * _SIDE + side[1:][~sure])
            waiting += len(held[-1])
            if waiting > HELD_CONTEXTS or numbers.n_others > COUNTED_WORDS:
                yield rows()
                numbers.forget_others()
                held.clear()
                waiting = 0
        yield rows()
        at = np.flatnonzero(counts)
        nothing = pa.nulls(len(at), pa.binary())
        left, right = (pa.array(x.astype(np.int32)) for x in np.divmod(at, size))
        yield pa.RecordBatch.from_arrays([nothing, left, nothing, right, pa.array(counts[at])], names=["left_word", "left", "right_word", "right", "n"])

    schema = "left_word binary, left int, right_word binary, right int, n long"
    found = materialize(map_batches(train.select(F.col(text).alias("text")), run, schema), "class_pairs")
    learned = rest.filter(F.col("cls").isNotNull()).select(F.col("word").alias("of"), "cls")
    for side in ("left", "right"):
        word = F.col(f"{side}_word")
        looked_up = found.filter(word.isNotNull()).join(learned, word == F.col("of"), "left").withColumn(side, F.coalesce("cls", side)).drop("of", "cls")
        found = looked_up.unionByName(found.filter(word.isNull()))
    pairs = np.zeros((size, size))
    summed = found.groupBy("left", "right").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    pairs[summed.column("left").to_numpy(), summed.column("right").to_numpy()] = summed.column("n").to_numpy()
    return pairs


def exchange(transitions: np.ndarray, words: int, classes: int = CLASSES, rounds: int = EXCHANGE_ROUNDS) -> np.ndarray:
    """A class for each symbol: the first ``words`` symbols, given by descending frequency, are assigned to ``classes`` classes, and every
    other symbol keeps a class of its own. Each word in turn moves to the class with which the likelihood of the class bigrams is
    highest, until no word moves."""
    n = len(transitions)
    classes = min(classes, max(1, words))
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(n - words)])
    total = classes + n - words
    x_log_x = lambda x: x * np.log(np.maximum(x, 1))
    sums = np.zeros((total, n))
    np.add.at(sums, of, transitions)
    pairs = np.zeros((total, total))
    np.add.at(pairs.T, of, sums.T)
    k = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            out = np.bincount(of, transitions[w], total)
            into = np.bincount(of, transitions[:, w], total)
            own, c = float(transitions[w, w]), of[w]
            out[c] -= own
            into[c] -= own
            pairs[c] -= out
            pairs[:, c] -= into
            pairs[c, c] -= own
            left, right = pairs.sum(axis=1)[k], pairs.sum(axis=0)[k]
            rows, columns = pairs[k], pairs[:, k].T
            gain = (x_log_x(rows + out) - x_log_x(rows)).sum(axis=1) + (x_log_x(columns + into) - x_log_x(columns)).sum(axis=1)
            both = pairs[k, k]
            gain += x_log_x(both + out[k] + into[k] + own) + x_log_x(both) - x_log_x(both + out[k]) - x_log_x(both + into[k])
            n_out, n_into = out.sum() + own, into.sum() + own
            gain -= x_log_x(left + n_out) - x_log_x(left) + x_log_x(right + n_into) - x_log_x(right)
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            moved += best != c
            of[w] = best
            pairs[best] += out
            pairs[:, best] += into
            pairs[best, best] += own
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """What scoring needs in every task: the head words with their counts and classes, and the classes' tables."""

    words: list[bytes]  # by descending count; the first ones are clustered
    counts: np.ndarray
    clustered: int
    classes: np.ndarray  # of the symbols
    head_classes: np.ndarray  # of the words
    moves: np.ndarray  # log10 of a class's probability after a class
    totals: np.ndarray  # log10 of a class's smoothed number of tokens
    ends: int  # training texts
    tokens: int
    distinct: int

    @property
    def base_total(self) -> float:
        return math.log10(self.tokens + WORD_PRIOR * (self.distinct + 1))


def head_threshold(counts: DataFrame, most: int = HEAD_WORDS) -> int:
    """The smallest count on a fixed scale that at most ``most`` words have or exceed."""
    n = F.col("n")
    # every count up to 1000, then steps of a tenth
    step = F.when(n <= 1000, n).otherwise(F.floor(F.lit(1000.0) * F.pow(F.lit(1.1), F.floor(F.log(n / 1000) / math.log(1.1)))))
    rows = counts.groupBy(step.cast("long").alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # about 1,300 at most
    held, threshold = 0, None
    for row in sorted(rows, key=lambda r: -r["step"]):
        if held + row["words"] > most:
            break
        held += row["words"]
        threshold = row["step"]
    return threshold if threshold is not None else max((r["step"] for r in rows), default=0) + (1 << 40)


def train_model(train: DataFrame, text: str = "text") -> tuple[ClassModel, DataFrame]:
    """The model of all texts of ``train``, and the counts and learned classes ``(word, n, cls)`` of the words that it doesn't hold; ``cls`` is null for
    words with the class of their shape.

    The core's classes come from exchange clustering on the driver. Every other word with ``LEARNED_FROM`` occurrences joins the class of highest gain, in
    tasks, by its own neighbours; these are summed up in a table that grows with the input. Then the class bigrams are counted by the classes of all words."""
    counts = materialize(count_words(train, text), "word_counts")
    tokens, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    least = head_threshold(counts)
    head = [(bytes(r.word), r.n) for r in counts.filter(F.col("n") >= least).collect()]  # HEAD_WORDS rows at most
    head = sorted((w for w in head if w[0] != END), key=lambda x: (-x[1], x[0]))
    symbols = Symbols([w for w, _ in head[:CLUSTERED]])
    core = len(symbols.clustered)
    transitions = count_transitions(train, symbols, text)
    classes = exchange(transitions, core)
    size = int(classes.max()) + 1
    pairs = np.zeros((size, size))
    np.add.at(pairs, (classes[:, None], classes[None, :]), transitions)
    learned = learn_classes(count_contexts(train, symbols, classes, text), pairs, min(CLASSES, max(1, core)))
    learned = learned.withColumnRenamed("word", "of")
    counts = materialize(counts.join(learned, F.col("word") == F.col("of"), "left").select("word", "n", "cls"), "word_classes")
    rest = counts.filter((F.col("n") < least) & (F.col("word") != F.lit(END)))
    known = {bytes(r.word): r.cls for r in counts.filter((F.col("n") >= least) & F.col("cls").isNotNull()).select("word", "cls").collect()}
    shapes = classes[symbols.end + 1 :]
    others = [known[w] if w in known else shapes[shape_of(w)] for w, _ in head[core:]]
    head_classes = np.concatenate([classes[:core], np.array(others, np.int64)])
    pairs = count_class_pairs(train, [w for w, _ in head], head_classes, int(classes[symbols.end]), shapes, size, rest, text)
    # a class's successors, smoothed with the classes' frequencies and those with a uniform share
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + size)
    moves = np.log10((pairs + CLASS_PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + CLASS_PRIOR))
    # words of each class: clustered ones are known, the others are counted in the table
    words = np.bincount(classes[:core], minlength=size).astype(float)
    words[classes[symbols.end]] = 1
    for row in counts.filter(F.col("cls").isNotNull()).groupBy("cls").count().collect():
        words[row["cls"]] += row["count"]
    words[shapes] = _words_by_shape(counts.filter(F.col("cls").isNull()), symbols, text)
    totals = np.log10(pairs.sum(axis=0) + WORD_PRIOR * (words + 1))
    model = ClassModel(
        [w for w, _ in head], np.array([n for _, n in head], np.float64), core, classes, head_classes, moves, totals, ends, int(tokens or 0), int(distinct)
    )
    return model, rest


def _words_by_shape(counts: DataFrame, symbols: Symbols, text: str) -> np.ndarray:
    """How many distinct words of each shape ``counts`` has besides the clustered ones."""
    known = frozenset(symbols.clustered)

    def run(batches):
        found = np.zeros(SHAPES, np.int64)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                if word and word not in known:
                    found[shape_of(word)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(found)], names=["shape", "n"])

    out = np.zeros(SHAPES)
    for row in map_batches(counts.select("word"), run, "shape long, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        out[row["shape"]] = row["n"]
    return out


def score_texts(docs: DataFrame, model: ClassModel, rest: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(<doc_id>, n_tokens, n_known, train_tokens, base_score, score)``, one for each row of ``docs``.

    ``score`` is the log10 probability of the text's words and its end: for each, the probability of its class after the class before
    times the word's share of its class. ``base_score`` is the same by the words' smoothed frequencies alone. A task knows the counts of the head
    words; the distinct other words of each text are joined with ``rest``, and what they add by their counts and classes is summed up by text.

    A null or empty text has the end alone. Repeated rows give repeated results, an empty table no rows; other columns are not looked at.
    Without any training text the model is uniform over one unknown word for each class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.select(F.col(doc_id).alias("key"))
    ddl = (
        "row long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<long>, "
        # for each other word its shape's class; for each place of one: which word it is, and the classes beside it, or -1 for another such word
        "shapes array<int>, which array<int>, before array<int>, after array<int>"
    )
    schema = StructType([*key.schema.fields, *StructType.fromDDL(ddl).fields])

    def run(batches):
        m: ClassModel = shared.value
        numbers = Numbers([*m.words, END])
        end, first = m.clustered, TaskContext.get().partitionId() << 40
        end_class = m.classes[end]
        logs = np.log10(np.append(m.counts, m.ends) + WORD_PRIOR)
        head_classes = np.append(m.head_classes, end_class)
        there = np.append(np.ones(len(m.words), np.int64), m.ends > 0)
        for part in text_slices(batches):
            every = _tokens(raw_texts(part.column("text")))
            ids = numbers.of(every)[1:]
            ends = np.flatnonzero(ids == len(m.words)) + 1
            starts = np.append(0, ends[:-1])
            n_others = numbers.n_others
            of = np.append(head_classes, np.full(n_others, -1))[ids]
            gain = np.append(logs, np.zeros(n_others))[ids]
            known_here = np.append(there, np.zeros(n_others, np.int64))[ids]
            at = np.flatnonzero(of < 0)
            before = np.append(end_class, of[:-1])  # the end goes before each text
            after = np.append(of[1:], end_class)
            base = np.add.reduceat(gain, starts)
            sure = of >= 0
            moves = np.where(sure & (before >= 0), m.moves[before, of], 0.0) - np.where(sure, m.totals[of], 0.0)
            score = np.add.reduceat(gain + moves, starts)
            # the distinct other words of each text, and which of them stands at each place
            bounds = np.searchsorted(at, np.append(starts, len(ids)))
            cells, place, counts = np.unique(
                np.repeat(np.arange(len(starts)), np.diff(bounds)) * _SIDE + ids[at] - numbers.given, return_inverse=True, return_counts=True
            )
            text, word = np.divmod(cells, _SIDE)
            firsts = np.searchsorted(text, np.arange(len(starts) + 1))
            which = place - np.repeat(firsts[:-1], np.diff(bounds))
            per_text = lambda x: pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), x)  # noqa: E731, B023
            words, times = per_text(numbers.others().take(pa.array(word))), per_text(pa.array(counts, pa.int64()))
            shapes = per_text(pa.array(m.classes[end + 1 + numbers.shapes_of_others()[word]], pa.int32()))
            if n_others > COUNTED_WORDS:
                numbers.forget_others()
            sizes = ends - starts
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(first + np.arange(part.num_rows)),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(known_here, starts)),
                    pa.array(base - sizes * m.base_total),
                    pa.array(score),
                    words,
                    times,
                    shapes,
                    *(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (which, before[at], after[at])),
                ],
                names=schema.names,
            )
            first += part.num_rows

    rows = map_batches(docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")), run, schema)
    rows = materialize(rows, "scored")
    listed = rows.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("pos", "x"))
    listed = listed.select("row", "pos", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = listed.join(rest.select(F.col("word").alias("of"), "n", "cls"), F.col("word") == F.col("of"), "left")
    count = F.coalesce("n", F.lit(0))
    added = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(count + F.lit(WORD_PRIOR))).alias("more"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"),
        F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("pos", "cls"))).alias("learned"),
    )
    joined = rows.drop("words", "times").join(added.withColumnRenamed("row", "of_row"), F.col("row") == F.col("of_row"), "left")
    more, nothing = F.coalesce("more", F.lit(0.0)), F.array().cast("array<int>")
    joined = joined.select(
        "key",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
        *("shapes", "which", "before", "after"),
        F.coalesce("learned.pos", nothing).alias("pos"),
        F.coalesce("learned.cls", nothing).alias("cls"),
    )
    whole = StructType([*key.schema.fields, *StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])

    def with_classes(batches):
        m: ClassModel = shared.value
        for batch in batches:
            flat = {k: batch.column(k).flatten().to_numpy().astype(np.int64) for k in ("shapes", "which", "before", "after", "pos", "cls")}
            sizes = {k: batch.column(k).value_lengths().to_numpy() for k in ("shapes", "which", "pos")}
            first = np.cumsum(sizes["shapes"]) - sizes["shapes"]
            of_word = flat["shapes"].copy()
            of_word[np.repeat(first, sizes["pos"]) + flat["pos"]] = flat["cls"]
            of = of_word[np.repeat(first, sizes["which"]) + flat["which"]]
            before = np.where(flat["before"] >= 0, flat["before"], np.append(of[:1], of[:-1]))
            moves = m.moves[before, of] - m.totals[of] + np.where(flat["after"] >= 0, m.moves[of, flat["after"]], 0.0)
            more = np.bincount(np.repeat(np.arange(batch.num_rows), sizes["which"]), moves, batch.num_rows)
            score = batch.column("score").to_numpy() + more
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)], names=whole.names)

    return map_batches(joined, with_classes, whole).select(
        F.col("key").alias(doc_id), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` scored by a model of the documents that are not held out (see ``learnable``), with ``held_out``."""
    model, rest = train_model(docs.filter(learnable(F.col(doc_id))), text)
    scored = score_texts(docs, model, rest, doc_id, text)
    return scored.withColumn("held_out", ~learnable(F.col(doc_id)))
