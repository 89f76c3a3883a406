"""Scoring documents by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models, one of the target documents and one of all documents, share one
vocabulary, one order and one smoothing, and the counts of the larger are scaled to the
tokens of the smaller, so that only what differs in the texts makes a difference. A
document's score is its loss per token under the target model less that under the
background model: the lower, the more it is like the target.

The vocabulary is every word of the corpus, and every pair of neighbouring words has a count
of its own. No model is held in one place:

1. Tasks turn their texts into blocks of about ``BLOCK`` bytes: the distinct words and, for
   each token, the number of its word.
2. A block asks for each of its distinct words and pairs once, with its own counts. Requests
   are dealt by the hash of what they ask for; each share adds up the counts and answers the
   blocks with the counts of all documents and of the targets.
3. A block meets its answers again and scores its documents. A document's own words and pairs
   are taken from the counts first, from the target's too if it is one, so each is scored by
   models that have not seen it.

Shares are as many as the tokens need, so a task holds one block or one share whatever the
size of the corpus. A word in every document is one request of each block.

Smoothing adds one to the count of every word of the corpus.

Words are runs of letters, marks and digits, lower-cased, and runs of other characters that
are not white space: how a text is punctuated tells junk from prose. A text without words has 0 tokens
and null losses. Documents without doc_id are background. Rows that repeat an id or a text
are documents of their own: a copy elsewhere stays in the counts. Without any other target
document both models are alike and the difference is 0. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ebbtide.llm import words as W
from ebbtide.llm.scratch import stored
from pyspark.sql import DataFrame, functions as F

#: Weight of the single-word model inside the pair model, in tokens.
PRIOR = 20.0
#: Bytes of texts of a block, if no single text is longer.
BLOCK = 8 << 20
#: Tokens for each share of the requests, and the fewest shares as a power of two.
SHARE, LEAST_BITS = 4 << 20, 8


def _texts(docs: DataFrame) -> DataFrame:
    """The documents with one space between words."""
    apart = F.regexp_replace(F.lower(docs["text"]), r"([^\p{L}\p{M}\p{N}\s]+)", " $1 ")
    return docs.select(docs["doc_id"].alias("doc_id"),
                       F.trim(F.regexp_replace(apart, r"\s+", " ")).alias("text"))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: planes of zeros take no room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).reshape(n)


def blocks(texts: DataFrame) -> DataFrame:
    """``(doc_ids, lengths, words, tokens)``: of each block the documents, their numbers of
    tokens, the hashes of its words from the most frequent on, and each token's word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, most=BLOCK):
            rows, hashes = W.words(batch.column(1))
            words, token, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            lengths = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([words[order].tobytes()], pa.binary()),
                pa.array([_packed(rank[token].astype(np.int64))], pa.binary())],
                names=["doc_ids", "lengths", "words", "tokens"])

    return texts.mapInArrow(
        run, "doc_ids array<long>, lengths array<long>, words binary, tokens binary")


class _Block:
    """The tokens of a block and its distinct words and pairs, sorted by key. Keys of words
    are odd, those of pairs even."""

    def __init__(self, lengths: list[int], words: bytes, tokens: bytes) -> None:
        self.lengths = np.array(lengths, np.int64)
        token = _unpacked(tokens, int(self.lengths.sum()))
        hashes = np.frombuffer(words, np.uint64)
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        later = np.zeros(len(token), dtype=bool)
        later[1:] = self.row[1:] == self.row[:-1]
        #: Places of the tokens that follow another one of their document.
        self.later = np.flatnonzero(later)
        code, pair = np.unique(token[self.later - 1] * len(hashes) + token[self.later],
                               return_inverse=True)
        before, after = np.divmod(code, max(1, len(hashes)))
        base = np.uint64(W.BASE)
        both = W.mixed(hashes[before] * base + hashes[after] * (base * base))
        odd = np.uint64(1)
        keys = np.concatenate((hashes | odd, both & ~odd))
        order = np.argsort(keys, kind="stable")
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        self.keys = keys[order]
        #: The entry of each token's word, and of the pair that each later token ends.
        self.word, self.pair = at[token], at[len(hashes) + pair]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """Of each entry, how often it occurs in the chosen documents, and how often there
        it is followed by a word."""
        taken = chosen[self.row]
        follows = taken[self.later]
        n = len(self.keys)
        return np.array([np.bincount(self.word[taken], minlength=n)
                         + np.bincount(self.pair[follows], minlength=n),
                         np.bincount(self.word[self.later - 1][follows], minlength=n)], np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Within its own document, how often each token's word occurs, and of each later
        token how often its pair does and how often the word before it is followed."""
        n = len(self.keys)

        def times(code: np.ndarray) -> np.ndarray:
            _, at, count = np.unique(code, return_inverse=True, return_counts=True)
            return count[at]

        row = self.row[self.later]
        return (times(self.row * n + self.word), times(row * n + self.pair),
                times(row * n + self.word[self.later - 1]))


def requests(found: DataFrame, bits: int) -> DataFrame:
    """``(share, block, n, keys, counts)``: what each block asks of each share. Counts are
    those of all documents, then those of its targets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block = _Block(row["lengths"], row["words"], row["tokens"])
                wanted = np.zeros(len(block.lengths), dtype=bool)
                wanted[row["targets"] or []] = True
                counts = np.concatenate((block.counts(np.ones_like(wanted)), block.counts(wanted)))
                share = (block.keys >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(share, prepend=-1))
                ends = np.append(first[1:], len(share))
                keys = [_packed(np.diff(block.keys[a:b], prepend=np.uint64(0)))
                        for a, b in zip(first, ends)]
                sums = [_packed(counts[:, a:b].ravel()) for a, b in zip(first, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(share[first]), pa.array(np.full(len(first), row["block"])),
                     pa.array(ends - first), pa.array(keys, pa.binary()),
                     pa.array(sums, pa.binary())], names=["share", "block", "n", "keys", "counts"])

    return found.mapInArrow(run, "share long, block long, n long, keys binary, counts binary")


ANSWER = "share long, block long, n long, counts binary, words long, every long, target long"


def answers(asked: DataFrame) -> DataFrame:
    """The requests with the counts of all blocks. One row of each share also has the number
    of its words and their tokens."""
    def run(group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy()
        ends = np.cumsum(n)
        keys = np.concatenate([np.cumsum(_unpacked(k.as_py(), m).view(np.uint64))
                               for k, m in zip(group["keys"], n.tolist())])
        counts = np.concatenate([_unpacked(c.as_py(), 4 * m).reshape(4, m)
                                 for c, m in zip(group["counts"], n.tolist())], axis=1)
        known, at = np.unique(keys, return_inverse=True)
        # Sums are whole numbers below 2 ** 53.
        total = np.array([np.bincount(at, c, len(known)) for c in counts]).astype(np.int64)
        back = [_packed(total[:, at[b - m:b]].ravel()) for b, m in zip(ends.tolist(), n.tolist())]
        word = known & np.uint64(1) == 1
        once = [[int(v)] + [0] * (len(n) - 1)
                for v in (word.sum(), total[0, word].sum(), total[2, word].sum())]
        return pa.table([group["share"], group["block"], group["n"], pa.array(back, pa.binary()),
                         *[pa.array(v, pa.int64()) for v in once]],
                        names=["share", "block", "n", "counts", "words", "every", "target"])

    return asked.groupBy("share").applyInArrow(run, ANSWER)


def losses(found: DataFrame, answered: DataFrame, size: int, tokens: tuple[int, int]) -> DataFrame:
    """``(doc_id, tokens, target_loss, background_loss)``, losses per token in nats, from a
    vocabulary of ``size`` words and the tokens of all documents and of the targets. Each
    document's own counts are taken out."""
    names = ["doc_id", "tokens", "target_loss", "background_loss"]

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        at = _Block(row["lengths"], row["words"], row["tokens"])
        answer = answer.sort_by("share")
        counts = np.concatenate([np.zeros((4, 0), np.int64), *[
            _unpacked(c.as_py(), 4 * m.as_py()).reshape(4, m.as_py())
            for c, m in zip(answer["counts"], answer["n"])]], axis=1)
        docs = len(at.lengths)
        wanted = np.zeros(docs, dtype=bool)
        wanted[row["targets"] or []] = True
        words, pairs, followed = at.own()
        # Tokens of both models without the document's own, by document.
        left = {0: tokens[0] - at.lengths, 2: tokens[1] - at.lengths * wanted}
        least = np.minimum(left[0], left[2])
        out = []
        for of, mine in ((2, wanted), (0, np.ones_like(wanted))):
            total = left[of]
            scale = np.divide(least, total, out=np.zeros(docs), where=total > 0)
            of_token, own = scale[at.row], mine[at.row]
            each = ((counts[of][at.word] - words * own) * of_token + 1) / (
                (total * scale)[at.row] + size)
            of_pair, own = of_token[at.later], own[at.later]
            seen = (counts[of][at.pair] - pairs * own) * of_pair
            before = (counts[of + 1][at.word[at.later - 1]] - followed * own) * of_pair
            each[at.later] = (seen + PRIOR * each[at.later]) / (before + PRIOR)
            loss = -np.bincount(at.row, np.log(each), docs) / np.maximum(at.lengths, 1)
            out.append(pa.array(loss, mask=at.lengths == 0))
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(at.lengths), *out],
                        names=names)

    return found.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        run, "doc_id long, tokens long, target_loss double, background_loss double")


def scored(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, tokens, target_loss, background_loss, difference)`` per document.

    ``targets`` has the ids of the target documents in a column ``doc_id``.
    """
    found = stored(blocks(_texts(docs)).withColumn("block", F.monotonically_increasing_id()),
                   "blocks")
    ids = targets.select(targets["doc_id"].alias("wanted")).where("wanted IS NOT NULL").distinct()
    rows = found.select("block", F.posexplode("doc_ids").alias("place", "id"))
    chosen = rows.join(ids, rows["id"] == ids["wanted"], "left_semi").groupBy("block").agg(
        F.collect_list("place").alias("targets"))
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    n = found.agg(F.sum(length)).first()[0] or 0
    bits = max(LEAST_BITS, (n // SHARE).bit_length())
    found = found.join(chosen, "block", "left").select(
        "block", "doc_ids", "lengths", "words", "tokens", "targets")
    answered = stored(answers(requests(found.drop("doc_ids"), bits)), "answers")
    size, every, target = answered.agg(F.sum("words"), F.sum("every"), F.sum("target")).first()
    result = losses(found, answered.select("share", "block", "n", "counts"),
                    max(1, size or 0), (every or 0, target or 0))
    return result.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
