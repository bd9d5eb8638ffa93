"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. Windows of
``window_tokens`` tokens are filled to target proportions: those asked for, or
the sources' shares of all tokens, by which all queues drain together. In each
window a queue's deficit grows by its exact share of the window, it sends the
whole tokens of that, and the fraction is carried on. A queue that runs dry
leaves its share to the others, by their proportions, from that very token on.
So what a queue has sent up to a window has a closed form, piecewise linear
between the points at which queues run dry: a task carries on where another
partition ends without waiting for it. Windows follow each other without a gap
and sequences are cut from them; only the last one is not full.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from fractions import Fraction
from functools import lru_cache
from math import lcm

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import null_key, stored, table

SEQUENCE = 1024
WINDOW = 64 * SEQUENCE
END_ID = 0
#: Queues at most, beside those of sources with a proportion of their own: where there are more sources they share queues by hash.
QUEUES = 1024


def default_vocabulary() -> tuple[str, str]:
    """The public byte-level vocabulary as the two libraries' files: (tokenizer JSON, ranks)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Ranks:
    """The quicker encoder; texts that hold the literal of an added token go to the tokenizer, which alone knows them."""

    def __init__(self, exact, ranks):
        self.exact, self.ranks = exact, ranks
        self.literals = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode_ordinary(self, text: str) -> list[int]:
        if any(x in text for x in self.literals):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None):
    import base64

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    quick = None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = _Ranks(exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return exact, quick


def encode(text: str, json_path: str, ranks_path: str | None) -> list[int]:
    """Ids of the tokenizer file. Given ranks of the same vocabulary, these encode text
    that is within Latin scripts and common punctuation, where both splitters agree; it is the quicker way."""
    exact, quick = _encoders(json_path, ranks_path)
    if quick is not None and (text.isascii() or max(text) < "ɐ"):
        return quick.encode_ordinary(text)
    return exact.encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, json_path: str, ranks_path: str | None) -> DataFrame:
    """doc_id, skey, part, before, doc_tokens and ids, stored.

    ``before`` counts the tokens of earlier documents of the same source in the
    same partition; with the partition's number that fixes the queue's order.
    """

    def run(batches):
        part, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for doc_id, skey, text in zip(batch["doc_id"], batch["skey"], batch["text"]):
                ids = np.asarray([*(encode(text, json_path, ranks_path) if text else []), END_ID], dtype="<u4")
                before = sent.get(skey, 0)
                sent[skey] = before + len(ids)
                out.append((doc_id, skey, part, before, len(ids), ids.astype("<u2" if ids.max() < 65536 else "<u4").tobytes()))
                if len(out) >= 500:
                    yield frame(out)
                    out = []
            yield frame(out)

    def frame(rows):
        f = pd.DataFrame(rows, columns=["doc_id", "skey", "part", "before", "doc_tokens", "ids"])
        f["doc_id"] = f["doc_id"].astype("Int64")
        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_key(F.col("source")).alias("skey"), "text")
    rows = rows.mapInPandas(run, "doc_id long, skey string, part int, before long, doc_tokens long, ids binary")
    return stored(rows, "tokens")


def queue_offsets(tokens: DataFrame, named: list[str]) -> tuple[DataFrame, list]:
    """(skey, part, queue, offset): tokens of the queue before; and [(queue, total)] in order, ``QUEUES`` + ``named`` at most.

    A queue is in order of partition, then of source.
    """
    per = stored(tokens.groupBy("skey", "part").agg(F.sum("doc_tokens").alias("n")), "per")
    few = per.select("skey").distinct().count() <= QUEUES
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("skey"), F.lit(QUEUES)).cast("string"))
    queue = F.col("skey") if few else F.when(F.col("skey").isin(named), F.col("skey")).otherwise(shared)
    before = Window.partitionBy("queue").orderBy("part", "skey").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("queue", queue).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per = stored(per, "offsets")
    totals = per.groupBy("queue").agg(F.sum("n").alias("total")).orderBy("queue").collect()
    return per.drop("n"), [(r["queue"], r["total"]) for r in totals]


class Schedule:
    """What each queue has sent by each window, exactly: queues weigh whole numbers."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.window, self.total = totals, weights, window, sum(totals)
        self.windows = max(1, -(-self.total // window))
        #: By turns in which queues run dry: tokens sent by then, tokens of queues dry before, weight of the others.
        self.ends, self.dry, self.active, self.times = [], [], [], []
        gone, weight = 0, sum(weights)
        for s in sorted(range(len(totals)), key=lambda s: (Fraction(totals[s], weights[s]), s)):
            time = Fraction(totals[s], weights[s])
            self.ends.append(gone + time * weight)
            self.dry.append(gone)
            self.active.append(weight)
            self.times.append(float(time))
            gone, weight = gone + totals[s], weight - weights[s]
        self._known: dict[int, np.ndarray] = {}
        self._begin: dict[int, np.ndarray] = {}

    def sent(self, w: int) -> np.ndarray:
        """Tokens that each queue has sent before window ``w``."""
        if w not in self._known:
            if len(self._known) > 512:
                self._known.clear()
                self._begin.clear()
            if w >= self.windows:
                now = self.totals
            else:
                turn = bisect_left(self.ends, w * self.window)
                part, of = w * self.window - self.dry[turn], self.active[turn]
                now = [min(t, p * part // of) for t, p in zip(self.totals, self.weights)]
            self._known[w] = np.array(now, dtype=np.int64)
        return self._known[w]

    def begin(self, w: int) -> np.ndarray:
        """Where each queue's part of window ``w`` begins in the whole output."""
        if w not in self._begin:
            low = self.sent(w)
            size = self.sent(w + 1) - low
            self._begin[w] = low.sum() + np.cumsum(size) - size
        return self._begin[w]

    def window_of(self, s: int, at: int) -> int:
        """The window in which queue ``s`` sends its token number ``at``."""
        time = at / self.weights[s]
        turn = min(bisect_left(self.times, time), len(self.times) - 1)
        w = int((self.dry[turn] + time * self.active[turn]) // self.window)
        w = max(0, min(w, self.windows - 1))
        while w and self.sent(w)[s] > at:
            w -= 1
        while self.sent(w + 1)[s] <= at:
            w += 1
        return w


def whole_weights(weights: list) -> list[int]:
    """The same proportions in whole numbers."""
    exact = [Fraction(str(w)) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("proportions must be above 0")
    scale = lcm(*[w.denominator for w in exact])
    return [int(w * scale) for w in exact]


def place(start, queue, length, schedule: Schedule, sequence: int):
    """Cuts queue ranges [start, start+length) at window and sequence ends.

    Returns (row, begin in the row, length, position in the whole output).
    """
    rows, begins, sizes, places = [], [], [], []
    for r, (c, s, n) in enumerate(zip(start, queue, length)):
        end, at, w = c + n, c, schedule.window_of(s, c)
        while at < end:
            while schedule.sent(w + 1)[s] <= at:
                w += 1
            stop = min(end, int(schedule.sent(w + 1)[s]))
            base = int(schedule.begin(w)[s]) + at - int(schedule.sent(w)[s])
            while at < stop:
                size = min(stop - at, sequence - base % sequence)
                rows.append(r)
                begins.append(at - c)
                sizes.append(size)
                places.append(base)
                at, base = at + size, base + size
    return rows, begins, sizes, places


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, sequence: int = SEQUENCE, window: int = WINDOW, proportions: dict | None = None) -> DataFrame:
    """One row a piece: where which ids of a document stand.

    ``proportions`` are the sources' target shares of each window, in any
    unit; sources without one share queues like the others and weigh 1 a queue.
    Without any, the targets are the sources' shares of all tokens. Every
    document is packed: once a queue is dry the others fill its place.

    Null text counts as empty: such a document is its end id alone. Null is a
    source of its own. Rows that repeat a doc_id are documents of their own
    and each is packed. An empty table gives no rows. Every sequence but the
    last is full; the last is padded by its reader. A text is encoded whole,
    in memory in proportion to it. Other columns, whatever their names, are
    not looked at.
    """
    if json_path is None:
        json_path, ranks_path = default_vocabulary()
    tokens = tokenized(docs, json_path, ranks_path)
    asked = {"" if k is None else f"={k}": w for k, w in (proportions or {}).items()}
    offsets, queues = queue_offsets(tokens, list(asked))
    if not queues:
        return docs.sparkSession.createDataFrame([], OUT)
    totals = [t for _, t in queues]
    weights = whole_weights([asked.get(k, 1) for k, _ in queues]) if asked else totals
    index = {k: i for i, (k, _) in enumerate(queues)}

    def run(batches):
        schedule = Schedule(totals, weights, window)
        for b in batches:
            if not len(b):
                continue
            start, length = (b["before"] + b["offset"]).to_numpy(), b["doc_tokens"].to_numpy()
            rows, begins, sizes, places = place(start.tolist(), [index[k] for k in b["queue"]], length.tolist(), schedule, sequence)
            rows = np.array(rows)
            blobs = [np.frombuffer(x, dtype="<u2" if len(x) == 2 * n else "<u4") for x, n in zip(b["ids"], length)]
            crcs = [zlib.crc32(blobs[r][p : p + n].astype("<u4").tobytes()) for r, p, n in zip(rows, begins, sizes)]
            places = np.array(places)
            names = b["skey"].str[1:].where(b["skey"] != "", None)
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].astype("Int64").to_numpy()[rows],
                    "start": begins,
                    "length": sizes,
                    "ids_crc32": crcs,
                    "doc_tokens": length[rows],
                    "sequence_id": places // sequence,
                    "offset": places % sequence,
                    "source": names.to_numpy()[rows],
                }
            )

    return tokens.join(offsets, ["skey", "part"]).select("doc_id", "skey", "queue", "before", "offset", "doc_tokens", "ids").mapInPandas(run, OUT)


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
