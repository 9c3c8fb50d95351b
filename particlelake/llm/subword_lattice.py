"""Marginal likelihood of texts under a unigram model over subword lattices.

The pieces are those of an existing vocabulary. Its scores give the first weights,
and expectation maximisation over all distinct training words turns them into piece
probabilities. A word is the sum over all its segmentations, by forward recursion in
log space; a text is its words and one end. Words start with the vocabulary's word
mark, so pieces never cross them and a word's likelihood does not depend on its
neighbours: lattices are built once per distinct word of the corpus.

A training word's lattice has one more arc, the whole word. Absolute discounting
gives it the word's count less a discount, and the mass taken from all words is what
the segmentations share, so the arcs of all words together stay a distribution.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, binary_values, column_values, in_slices, plain_names, row_signature, stored

MARK = "▁"
CHARACTER_BITS = 21
END = "</s>"
#: Words with their counts that every task gets; the count limit follows from the corpus.
FREQUENT_WORDS = 1 << 17
WORDS_AT_ONCE = 20_000
DOCS_AT_ONCE = 500
COUNTED_WORDS = 200_000


class Vocabulary:
    """Pieces of a vocabulary file; characters without a piece fall back to byte pieces."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, scores = [], []
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i)) or model.id_to_piece(i) == END:
                self.pieces.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.bytes = [self.ids[f"<0x{b:02X}>"] for b in range(256)]
        self.end = self.ids[END]
        inner = set(self.bytes) | {self.end}
        self.lattice = {p: i for p, i in self.ids.items() if i not in inner}
        self._grow()
        rank = np.empty(len(scores))
        rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(scores))
        first = 1 / (rank + 2)
        self.first_weights = np.log(first / first.sum())


    def _grow(self) -> None:
        """The pieces as a trie in sorted arrays: (state, character) -> next state, and its piece."""
        states, edges = {"": 0}, []
        for piece in self.lattice:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    edges.append((states[piece[: k - 1]] << CHARACTER_BITS | ord(piece[k - 1]), states[piece[:k]]))
        edges.sort()
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*edges))
        self.piece_at = np.full(len(states), -1, np.int64)
        for piece, number in self.lattice.items():
            self.piece_at[states[piece]] = number


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Lattices:
    """The edges of the lattices of many words, in flat arrays.

    Node ``base[w] + t`` is position t of word w; an edge carries a piece, or a
    fallback character numbered after the pieces.
    """

    def __init__(self, words: list[str], vocab: Vocabulary):
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        codes = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        stop = np.cumsum(lengths)[owner]
        begin, end, piece, covered = [], [], [], np.zeros(len(codes), bool)
        # All places of all words go down the trie together, one character a step.
        at, state, step = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            wanted = state << CHARACTER_BITS | codes[at + step]
            place = np.minimum(np.searchsorted(vocab.keys, wanted), len(vocab.keys) - 1)
            hit = vocab.keys[place] == wanted
            at, state = at[hit], vocab.next[place[hit]]
            found = vocab.piece_at[state]
            whole = at[found >= 0]
            begin.append(whole)
            end.append(whole + step + 1)
            piece.append(found[found >= 0])
            if step == 0:
                covered[whole] = True
            step += 1
            on = at + step < stop[at]
            at, state = at[on], state[on]
        bare = np.flatnonzero(~covered)
        characters, number = np.unique(codes[bare], return_inverse=True)
        begin, end = np.concatenate([*begin, bare]), np.concatenate([*end, bare + 1])
        self.piece = np.concatenate([*piece, number + len(vocab.pieces)])
        self.fallback = [[vocab.bytes[b] for b in chr(c).encode("utf-8")] for c in characters.tolist()]
        # A word has one node more than characters.
        self.word_of = word_of = owner[begin]
        self.begin, self.end = begin + word_of, end + word_of
        self.base = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.forward_steps = self._steps(self.end - self.base[word_of])
        self.backward_steps = self._steps(self.begin - self.base[word_of])[::-1]

    @staticmethod
    def _steps(position: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(position, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(position[order])) + 1) if len(order) else []

    def edge_weights(self, log_weights: np.ndarray) -> np.ndarray:
        extra = np.array([log_weights[b].sum() for b in self.fallback])
        return np.concatenate([log_weights, extra])[self.piece]

    @staticmethod
    def _pass(steps, into, source, weights, values) -> None:
        """``values[into]`` becomes the log of the summed exponentials over each step's edges."""
        for edges in steps:
            to = into[edges]
            x = values[source[edges]] + weights[edges]
            np.maximum.at(values, to, x)
            top = values[to]
            total = np.zeros(len(values)) if len(edges) * 8 > len(values) else None
            if total is not None:
                np.add.at(total, to, np.exp(x - top))
                nodes = np.unique(to)
                values[nodes] += np.log(total[nodes])
            else:
                nodes, place = np.unique(to, return_inverse=True)
                values[nodes] += np.log(np.bincount(place, weights=np.exp(x - top)))

    def forward(self, weights: np.ndarray) -> np.ndarray:
        alpha = np.full(self.base[-1], -np.inf)
        alpha[self.base[:-1]] = 0.0
        self._pass(self.forward_steps, self.end, self.begin, weights, alpha)
        return alpha

    def log_likelihoods(self, log_weights: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        return self.forward(self.edge_weights(log_weights))[self.base[1:] - 1]

    def expected_counts(self, log_weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur ``counts`` times."""
        weights = self.edge_weights(log_weights)
        alpha = self.forward(weights)
        beta = np.full(self.base[-1], -np.inf)
        beta[self.base[1:] - 1] = 0.0
        self._pass(self.backward_steps, self.begin, self.end, weights, beta)
        whole = alpha[self.base[1:] - 1]
        share = np.exp(alpha[self.begin] + weights + beta[self.end] - whole[self.word_of]) * counts[self.word_of]
        size = len(log_weights)
        used = np.bincount(self.piece, weights=share, minlength=size + len(self.fallback))
        expected = used[:size]
        for number, own in enumerate(self.fallback):
            np.add.at(expected, own, used[size + number])
        return expected


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of all texts, pre-aggregated in every task; ``n`` counts rows that are not held out, 0 for words of held-out rows alone."""

    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return batch

        for batch in in_slices(batches, DOCS_AT_ONCE):
            for text, held_out in zip(binary_values(batch, "text"), column_values(batch, "held_out")):
                if held_out:
                    for word in _words(text):
                        counts.setdefault(word, 0)
                else:
                    counts.update(_words(text))
            if len(counts) > COUNTED_WORDS:
                yield flush()
        if counts:
            yield flush()

    return rows.select("text", "held_out").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_likelihoods(counts: DataFrame, path: str, log_weights: np.ndarray) -> DataFrame:
    """``counts(word, n)`` with ``likely``, the log10 of the summed probability of all segmentations of the word."""
    shared = counts.sparkSession.sparkContext.broadcast(log_weights)

    def run(batches: Batches) -> Batches:
        own, weights = vocabulary(path), shared.value
        for batch in in_slices(batches, WORDS_AT_ONCE):
            if batch.num_rows:
                values = Lattices(column_values(batch, "word"), own).log_likelihoods(weights) / math.log(10)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=["word", "n", "likely"])

    return counts.select("word", "n").mapInArrow(run, "word string, n long, likely double")


def discount_of(counts: DataFrame) -> float:
    """The share of an occurrence that every word gives up: n1 / (n1 + 2 n2) of words found once and twice."""
    once, twice = counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def fit_pieces(counts: DataFrame, path: str, rounds: int = 2, smoothing: float = 0.1) -> np.ndarray:
    """Natural log probability of every piece after ``rounds`` of expectation maximisation.

    Every distinct word counts once, as segmentations are for words that are rare. Every round reads all distinct training words; tasks return sums per piece, so
    what reaches the driver is bounded by the vocabulary.
    """
    spark = counts.sparkSession
    vocab = vocabulary(path)
    log_weights = vocab.first_weights
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(log_weights)

        def run(batches: Batches, shared=shared) -> Batches:
            own, weights = vocabulary(path), shared.value
            total = np.zeros(len(weights))
            for batch in in_slices(batches, WORDS_AT_ONCE):
                words = column_values(batch, "word")
                if words:
                    total += Lattices(words, own).expected_counts(weights, np.ones(len(words)))
            used = np.flatnonzero(total)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

        expected = np.full(len(log_weights), smoothing)
        for row in counts.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[row["piece"]] += row["n"]
        expected[vocab.end] += 1
        log_weights = np.log(expected / expected.sum())
    return log_weights


def frequent_words(scored: DataFrame, limit: int) -> dict[bytes, tuple[int, float]]:
    """(n, likely) of words with at least a power of two occurrences, the smallest power that ``limit`` words or fewer reach."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = dict(scored.where("n > 0").groupBy(level.alias("level")).count().collect())
    total, lowest = 0, 63
    for step in range(62, -1, -1):
        total += sizes.get(step, 0)
        if total > limit:
            break
        lowest = step
    return {r["word"].encode("utf-8"): (r["n"], r["likely"]) for r in scored.where(F.col("n") >= 2**lowest).toLocalIterator()}


def lattice_scores(
    docs: DataFrame,
    vocabulary_path: str,
    held_out_of: int = 10,
    rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT_WORDS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) is divisible by ``held_out_of`` are held out, the
    others (and null ids) train. Tokens are the words in lower case (A-Z only) and one
    end. ``base_score`` is the smoothed word-unigram log10 probability, ``score`` the
    model's. Null and empty texts are an end alone. Repeated rows all come back and
    all train; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = plain_names(docs, (id_col, "doc_id"), (text_col, "text")).select(
        "doc_id", "text", row_signature(F.col("text")).alias("signature"),
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out_of)) == 0, F.lit(False)).alias("held_out"),
    )
    ends = rows.where(~F.col("held_out")).count()
    counts = stored(word_counts(rows), "words")
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, kinds = words + ends, distinct + (1 if ends else 0)
    divisor = tokens + 0.1 * (kinds + 1)
    discount = discount_of(counts)
    spread = discount * kinds / tokens if tokens else 1.0
    log_weights = fit_pieces(counts.where("n > 0"), vocabulary_path, rounds)
    vocab = vocabulary(vocabulary_path)
    starts = np.exp(log_weights[[i for p, i in vocab.lattice.items() if p.startswith(MARK)]]).sum()
    end_share = float(np.exp(log_weights[vocab.end]) / (starts + np.exp(log_weights[vocab.end])))
    end_score = math.log10((max(ends - discount, 0) / tokens if tokens else 0) + spread * end_share)
    scored = stored(word_likelihoods(counts, vocabulary_path, log_weights), "likelihoods")
    often = {
        word: (math.log10((n + 0.1) / divisor), math.log10((n - discount) / tokens + spread * 10**likely))
        for word, (n, likely) in frequent_words(scored, frequent).items()
    }
    model = spark.sparkContext.broadcast(often)
    end_base = math.log10((ends + 0.1) / divisor)

    def run(batches: Batches) -> Batches:
        value_of = model.value.get
        for batch in in_slices(batches, DOCS_AT_ONCE):
            owner, token, times, sums = [], [], [], []
            for row, text in enumerate(binary_values(batch, "text")):
                found = _words(text)
                known, base, score, before = 1 if ends else 0, end_base, end_score, len(token)
                for word, n in Counter(found).items():
                    value = value_of(word)
                    if value is None:
                        token.append(word)
                        times.append(n)
                    else:
                        known += n
                        base += n * value[0]
                        score += n * value[1]
                owner.append(len(token) - before)
                sums.append((len(found) + 1, known, base, score))
            rare, own = len(token), len(sums)
            take = pa.array(np.concatenate([np.repeat(np.arange(own), owner), np.arange(own)]).astype(np.int64))
            token.extend(b"of row %d" % row for row in range(own))
            number, known, base, score = (np.concatenate([np.zeros(rare, kind), np.array(x, kind)]) for kind, x in zip("qqdd", zip(*sums)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)).take(take) for c in ("doc_id", "signature", "held_out")),
                    pa.array(token, pa.binary()).cast(pa.string()), pa.array(np.array(times + [0] * own, "q")), pa.array(number),
                    pa.array(known), pa.array(base), pa.array(score), pa.array(np.repeat(np.array([0, 1], "q"), (rare, own))),
                ],
                names=["doc_id", "signature", "held_out", "word", "times", "n_tokens", "n_known", "base", "score", "copies"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(
        run,
        f"doc_id {kind}, signature long, held_out boolean, word string, times long, n_tokens long, n_known long, "
        "base double, score double, copies long",
    )
    # A row's own sums travel under a token with spaces, which is no word, one for each place in a batch.
    joined = parts.join(scored, "word", "left")
    count = F.coalesce("n", F.lit(0))
    rare = F.col("times") * F.log10((count + F.lit(0.1)) / F.lit(divisor))
    parted = F.lit(math.log10(spread)) + F.col("likely")
    arc = (F.col("n") - F.lit(discount)) / F.lit(max(tokens, 1))
    whole = F.when(count == 0, parted).otherwise(F.log10(arc + F.pow(F.lit(10.0), parted)))
    summed = joined.groupBy("doc_id", "signature", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(count > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare).alias("base_score"),
        F.sum(F.when(F.col("copies") > 0, F.col("score")).otherwise(F.col("times") * whole)).alias("score"),
        F.sum("copies").alias("copies"),
    )
    once = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return once.select(
        "doc_id", "held_out",
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )
