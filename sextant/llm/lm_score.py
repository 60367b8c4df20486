"""Language-model scoring: a causal self-attention model over subword ids (``lm_model``), trained on Spark.

Words (A-Z lower-cased) are cut into pieces of a public vocabulary. What the model learns grows
with the input: the counts that give its tree and first biases, and the text that its weights
are trained on, are of all training documents. Training takes ``ROUNDS`` rounds; in each, the
parts of that text go on separately from the same weights, and their changes are averaged in
Spark, block by block.

The unigram base is taken over all training documents: each group of documents sends every
distinct word once with its count, and learns the count of the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import drop, group_count, runs_at, settle
from sextant.llm.lm_model import COMPANY, Model, Trainer, add, apply

#: Rounds; bytes of a part of the training text, and parts at most (beyond that they grow); pieces to be seen at least, in several passes if need be.
ROUNDS, PART_BYTES, MOST_PARTS, LEAST_PIECES = 8, 4 << 20, 256, 5_000_000
#: What a task of Python looks at together, however many rows it is handed: ids, and bytes of text.
STEP, SLICE_BYTES = 1 << 18, 4 << 20


class Pieces:
    """A vocabulary of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.initial = np.array([self.model.id_to_piece(k).startswith("▁") for k in range(self.size)] + [True])

    def cut(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 50_000):
            found = self.model.encode(words[a : a + 50_000].to_pylist())
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint16, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def texts(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, each with the end (the id after the last piece), and how many each has."""
        words, at, n = words_of(texts)
        return self.laid_out(*self.cut(words), at, n)

    def laid_out(self, ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``texts``, from words cut before: ``at`` numbers the words of the documents, of which each has ``n``."""
        ids, sizes = np.append(ids, np.uint16(self.size)), np.append(sizes, 1)  # the end as one more word
        at = np.insert(at, np.cumsum(n), len(sizes) - 1)
        return runs_at(ids, sizes, at), np.add.reduceat(sizes[at], np.cumsum(n + 1) - n - 1) if len(n) else n


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


#: A row of the exchange of words: those of group g in one bucket, or (g = -1) what a bucket adds up to.
_ROW = "bucket int, g int, counts binary, words binary, n_words long, n_tokens long"
_NAMES = ["bucket", "g", "counts", "words", "n_words", "n_tokens"]
_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _rows(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.table({n: pa.array(list(c), k) for n, k, c in zip(_NAMES, _KINDS, columns, strict=True)})


def _summed(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows (code, sum), each code once."""
    found, where = np.unique(codes, return_inverse=True)
    return np.stack((found, np.bincount(where, times, len(found)).astype(np.int64)), axis=1).astype("<i8")


def words_of(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased, split at ASCII white space), the number of each word of all texts, and the words of each text."""
    # lower-cased before the cast: after it, Arrow reads a slice without nulls at the wrong places
    texts = pc.fill_null(pc.ascii_lower(texts).cast(pa.large_string()), "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty part
    edge = np.concatenate(([0], np.cumsum(filled)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(edge)


def _by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Words in order of their buckets (which word comes where), and each bucket's first and last place; the order depends on the words only."""
    bucket = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % buckets
    order = pc.sort_indices(pa.table({"bucket": bucket, "word": words}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
    ranked = bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else np.zeros(1, np.int64)
    return order, [(int(ranked[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def followers_of(columns: Iterable[pa.Array], rank: np.ndarray, end: int) -> np.ndarray:
    """Rows (piece << 16 | rank of the piece before, count) of sequences of ids; pieces before of rank -1 are not counted.

    Counts stand in one table of vocabulary by ``COMPANY``, and ``STEP`` ids are looked at together, however many a column holds.
    """
    total = np.zeros(len(rank) * COMPANY, np.int64)
    for column in columns:
        before = end  # what a sequence begins after, and ends with
        for sequence in column:
            ids = np.frombuffer(sequence.as_buffer(), "<u2")
            for a in range(0, len(ids), STEP):
                after = ids[a : a + STEP].astype(np.int64)
                ranks = rank[np.concatenate(([before], after[:-1]))]
                np.add.at(total, (after * COMPANY + ranks)[ranks >= 0], 1)
                before = after[-1]
    at = np.flatnonzero(total)
    return np.stack((at // COMPANY << 16 | at % COMPANY, total[at]), axis=1)


def slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Runs of rows that hold about ``most`` bytes of text each, one row at least."""
    filled = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edge = np.flatnonzero(np.diff(filled // most)) + 1 if len(filled) else filled
    yield from map(slice, [0, *edge.tolist()], [*edge.tolist(), len(filled)])


def train(sequences: DataFrame, counts: np.ndarray, initial: np.ndarray, parts: int, passes: int) -> Model:
    """A model from ``sequences`` (part, turn, id, ids): the ids of documents, dealt to ``parts`` parts and ``ROUNDS`` turns.

    counts and initial: see ``Model``. The driver only ever holds the model and its changes.
    """
    end = len(counts) - 1
    often = np.argsort(-counts, kind="stable")[:COMPANY]
    rank = np.full(len(counts), -1)
    rank[often] = np.arange(len(often))

    def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = followers_of((batch.column("ids") for batch in batches), rank, end)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["code", "n"])

    # at most COMPANY rows for each piece of the vocabulary
    pairs = sequences.select("ids").mapInArrow(followers, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    near = np.zeros((len(counts), COMPANY), np.float32)
    if pairs.num_rows:
        code = pairs.column("code").to_numpy()
        near[code >> 16, code & 0xFFFF] = pairs.column("n").to_numpy()
        near = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    model = Model(counts, initial, near)

    def learn(start, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, rng, held, size = Trainer(start.value), None, [], 0

        def go() -> None:
            for k in range(passes):
                trainer.learn(np.concatenate([np.array([end], np.int64), *held]), rng, (turn + k / passes) / ROUNDS)
            held.clear()

        for batch in batches:
            for part, ids in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                rng = rng or np.random.default_rng((part, turn))
                held.append(np.frombuffer(ids, "<u2").astype(np.int64))
                size += len(held[-1])
                if size >= 1 << 20:
                    go()
                    size = 0
        if held:
            go()
        changed = trainer.changes(start.value)
        own = [part if changed else 0] * len(changed)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in changed], pa.string()), pa.array(own, pa.int32()), pa.array([p for _, p in changed], pa.binary())], ["name", "part", "payload"])

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table({"name": table.column("name").slice(0, 1), "part": table.column("part").slice(0, 1), "payload": pa.array([add(table.column("payload").to_pylist())], pa.binary())})

    row = "name string, part int, payload binary"
    for turn in range(ROUNDS if pairs.num_rows else 0):
        start = sequences.sparkSession.sparkContext.broadcast(model)
        own = sequences.where(F.col("turn") == turn).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "id", "ids")
        changes = own.mapInArrow(partial(learn, start, turn), row).groupBy("name").applyInArrow(total, row)
        apply(model, sorted((r["name"], r["payload"]) for r in changes.collect()))  # as large as the model
        start.unpersist()
    return model


def score_documents(docs: DataFrame, held_out: Column, pieces: str, group_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``docs``: doc_id, text; others are not read unless ``held_out`` needs them. Held-out rows are
    scored but not learned from. A null text is empty: its one token is the end. With no training
    rows the base counts nothing as known and the model is its prior. Rows may repeat, doc_id may
    be null; an empty table gives an empty result. ``pieces`` is a sentencepiece vocabulary, at
    the same path on all machines. Only the model and the counts of its pieces (as many as the
    vocabulary has) are ever on the driver.
    """
    spark = docs.sparkSession
    groups = group_count(docs, F.octet_length("text"), group_bytes)
    group = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), group.alias("g"))
    by_group = rows.repartitionById(groups, F.col("g")).groupBy("g")

    def send(table: pa.Table) -> pa.Table:
        words, at, n = words_of(table.column("text"))
        learned = ~np.repeat(table.column("held_out").to_numpy(zero_copy_only=False).astype(bool), n)
        seen = np.bincount(at[learned], minlength=len(words)).astype("<u8")
        own, (order, parts) = table.column("g")[0].as_py(), _by_bucket(words, groups)
        words, seen = words.take(pa.array(order)), seen[order]
        return _rows([(k, own, seen[a:b].tobytes(), " ".join(words[a:b].to_pylist()).encode(), 0, 0) for k, a, b in parts])

    def add_up(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(c, "<u8") for c in table.column("counts").to_pylist()]
        coded = pc.split_pattern(table.column("words").combine_chunks().cast(pa.large_string()), " ").flatten().dictionary_encode()
        at, times = coded.indices.to_numpy(), np.concatenate(counts)
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, at, times.astype(np.int64))
        known = np.flatnonzero(total)
        ids, sizes = pieces_of(pieces).cut(coded.dictionary.take(pa.array(known)))
        listed = _summed(ids.astype(np.int64), np.repeat(total[known], sizes))
        replies = np.split(total[at].astype("<u8"), np.cumsum([len(c) for c in counts])[:-1])
        bucket = table.column("bucket")[0].as_py()
        out = [(bucket, g, r.tobytes(), b"", 0, 0) for g, r in zip(table.column("g").to_pylist(), replies, strict=True)]
        return _rows([*out, (bucket, -1, listed.tobytes(), b"", len(known), int(total.sum()))])

    sent = by_group.applyInArrow(send, _ROW).repartitionById(groups, F.col("bucket"))
    exchanged = settle(sent.groupBy("bucket").applyInArrow(add_up, _ROW), "words")

    # what the base and the model need of the whole
    sums = exchanged.where("g = -1")
    size, initial = pieces_of(pieces).size, pieces_of(pieces).initial

    def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i8").reshape(-1, 2)
            total = _summed(raw[:, 0], raw[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(total[:, 0]), pa.array(total[:, 1])], ["code", "n"])

    learned = rows.where(~F.col("held_out")).agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_docs, n_bytes = learned[0], learned[1] or 0
    whole = sums.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    vocabulary, train_tokens = (whole[0] or 0) + (n_docs > 0), (whole[1] or 0) + n_docs
    counts = np.zeros(size + 1, np.int64)
    listed = sums.select("counts").mapInArrow(add_codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts[listed.column("code").to_numpy()] = listed.column("n").to_numpy()
    counts[size] = n_docs

    # all training documents, dealt out by hash
    parts = int(min(MOST_PARTS, n_bytes // PART_BYTES + 1))
    passes = max(1, min(16, round(LEAST_PIECES / max(int(counts.sum()), 1))))
    dealt = F.xxhash64(F.lit("deal"), "doc_id", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(x.start, x.stop - x.start) for x in slices(whole.column("text"), SLICE_BYTES)):
                ids, sizes = pieces_of(pieces).texts(batch.column("text"))
                stops = np.cumsum(sizes)
                own = [ids[a:b].astype("<u2").tobytes() for a, b in zip(stops - sizes, stops, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("turn"), batch.column("id"), pa.array(own, pa.binary())], ["part", "turn", "id", "ids"])

    dealt_out = rows.where(~F.col("held_out")).select(
        F.pmod(dealt, F.lit(parts)).cast("int").alias("part"), F.pmod(F.shiftrightunsigned(dealt, 32), F.lit(ROUNDS)).cast("int").alias("turn"), F.col("doc_id").alias("id"), "text"
    )
    sequences = settle(dealt_out.mapInArrow(cut_up, "part int, turn int, id long, ids binary"), "sequences")
    model = spark.sparkContext.broadcast(train(sequences, counts, initial, parts, passes))
    drop(sequences)
    log_all, log_end = float(np.log10(train_tokens + vocabulary + 1)), float(np.log10(n_docs + 1))

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        words, at, n = words_of(texts.column("text"))
        order, parts = _by_bucket(words, groups)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist(), strict=True))
        known = np.zeros(len(words), np.int64)
        known[order] = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(told[k], "<u8") for k, _, _ in parts)])
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, np.log10(known + 1.0)[at], len(n)) + log_end - (n + 1) * log_all
        n_known = np.bincount(doc, (known > 0)[at], len(n)).astype(np.int64) + (n_docs > 0)
        ids, sizes = pieces_of(pieces).laid_out(*pieces_of(pieces).cut(words), at, n)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n + 1), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(n), train_tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(model.value.log10(ids, sizes)),
        })

    replies = exchanged.where("g >= 0").select("bucket", "g", "counts").repartitionById(groups, F.col("g"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_group.cogroup(replies.groupBy("g")).applyInArrow(score, out)
