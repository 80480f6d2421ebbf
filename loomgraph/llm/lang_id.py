"""Language identification by a byte convolutional network (operator 5).

A text's bytes are cut into windows of fixed length that cover it from end to
end.  Each byte is embedded, filters of widths 2 to 4 run over every position,
the largest response of each filter over the window is kept, and a softmax
layer turns these into probabilities.  A text's probabilities are those of its
windows, weighted by their bytes.  The network is trained in numpy on the
driver from a bounded sample and its weights (a few thousand numbers) go out
with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import _arrays as A
from ._shared import boxed, crc32_text, slices, unboxed

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 12
#: Training uses at most so many windows of each language, and of all together; no language is left out.
SAMPLE_WINDOWS, SAMPLE_ALL = 1500, 300_000
UNKNOWN = "und"
#: Windows that are classified together.
AT_ONCE = 1024
WIDE = max(WIDTHS)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDE * EMBED x filters; narrow filters are zero at the end
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter and its position; also the unfolded input."""
        n = len(windows)
        x = np.zeros((n, WINDOW + WIDE - 1, EMBED), dtype=np.float32)
        x[:, :WINDOW] = self.embed[windows]
        step = x.strides
        unfolded = np.lib.stride_tricks.as_strided(x, (n, WINDOW, WIDE * EMBED), (step[0], step[1], step[2])).reshape(n * WINDOW, -1)
        return (unfolded @ self.filters).reshape(n, WINDOW, -1), unfolded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        if not len(windows):
            return np.zeros((0, len(self.langs)))
        parts = []
        for i in range(0, len(windows), 256):
            response, _ = self.pooled(windows[i : i + 256])
            hidden = np.maximum(response.max(axis=1) + self.bias, 0)
            parts.append(softmax(hidden @ self.dense + self.out))
        return np.concatenate(parts)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of bytes of each window of all texts, and its text."""
    lengths = np.diff(offsets)
    per = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    start = offsets[:-1][text] + (np.arange(len(text)) - first[text]) * WINDOW
    return start, np.minimum(offsets[1:][text] - start, WINDOW), text


def as_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Zero-padded windows."""
    column = np.arange(WINDOW)
    windows = data[np.minimum(start[:, None] + column, max(len(data) - 1, 0))] if len(start) else np.zeros((0, WINDOW), np.uint8)
    windows[column >= size[:, None]] = 0
    return windows


def train(samples: list[tuple[str, str]], epochs: int = 6, seed: int = 5) -> Network:
    """Fit a network to (lang, text of at most a window) pairs by Adam."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in samples})
    raw = [text.encode()[:WINDOW] for _, text in samples]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    start, size, _ = spans(np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64))
    windows = as_windows(flat, start, size)
    y = np.searchsorted(langs, [lang for lang, _ in samples])
    mask = np.concatenate([np.repeat((np.arange(WIDE) < w).repeat(EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)
    k = mask.shape[1]
    normal = lambda *s: rng.standard_normal(s).astype(np.float32)
    net = Network(langs, 0.5 * normal(256, EMBED), (0.3 * normal(WIDE * EMBED, k) * mask).astype(np.float32), np.zeros(k, np.float32), 0.1 * normal(k, len(langs)), np.zeros(len(langs), np.float32))
    names = ("embed", "filters", "bias", "dense", "out")
    net.embed[0] = 0
    m = {p: np.zeros_like(getattr(net, p)) for p in names}
    v = {p: np.zeros_like(getattr(net, p)) for p in names}
    step = 0
    # every language counts alike, however many windows it has
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y].astype(np.float32)
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            b = order[i : i + 64]
            response, unfolded = net.pooled(windows[b])
            at = response.argmax(axis=1)
            top = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            dz = softmax(hidden @ net.dense + net.out)
            dz[np.arange(len(b)), y[b]] -= 1
            dz *= weight[b, None] / len(b)
            dh = (dz @ net.dense.T) * (top > 0)
            rows = np.arange(len(b))[:, None] * WINDOW + at
            source = unfolded[rows]  # batch x filters x (WIDE * EMBED)
            grad = {"dense": hidden.T @ dz, "out": dz.sum(0), "bias": dh.sum(0), "filters": np.einsum("bk,bkd->dk", dh, source) * mask}
            dx = (dh[:, :, None] * net.filters.T[None]).reshape(len(b), k, WIDE, EMBED)
            place = at[:, :, None] + np.arange(WIDE)
            inside = place < WINDOW
            byte = windows[b][np.arange(len(b))[:, None, None], np.minimum(place, WINDOW - 1)]
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], byte[inside], dx[inside])
            grad["embed"][0] = 0
            step += 1
            for p in names:
                g = grad[p]
                m[p] += 0.1 * (g - m[p])
                v[p] += 0.001 * (g * g - v[p])
                change = 0.004 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8)
                setattr(net, p, (getattr(net, p) - change).astype(np.float32))
    return net


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(crc32_text(doc_id) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, windows: int = SAMPLE_WINDOWS, most: int = SAMPLE_ALL) -> list[tuple[str, str]]:
    """At most ``windows`` pieces of text of each language, fewer where ``most`` over
    the number of languages is less, four from a document, at places that a hash
    of the text draws.  Every language that is given for a text has a part."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return []
    windows = max(1, min(windows, most // len(counts)))
    rates = [(r["lang"], min(1.0, max(0.4 * windows, 8.0) / r["count"])) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double"))
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    picked = known.select("lang", "text").join(share, "lang").filter(u < F.col("rate")).select("lang", "text", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    at = F.pmod(F.xxhash64("text", "k"), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    rows = picked.select("lang", F.substring("text", (at + 1).cast("int"), F.lit(WINDOW)).alias("piece"), F.xxhash64("text", "k").alias("h"))
    rows = rows.filter(F.col("piece").rlike(r"\p{L}")).orderBy("h", "lang", "piece").limit(max(2 * windows, 40) * len(counts)).collect()
    taken: dict[str, int] = {}
    out = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= windows:
            out.append((r["lang"], r["piece"]))
    return out


def predict(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts if there was nothing to learn from.
    """
    fields = docs.select(*keep).schema.fields

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_", 1 << 19):
            data, offsets, _ = A.flat(batch.column("text_"))
            n = batch.num_rows
            known = batch.column("letters_").to_numpy(zero_copy_only=False).astype(bool) & (net is not None)
            lang, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            if net is not None:
                start, size, text = spans(offsets)
                total = np.zeros((n, len(net.langs)))
                for i in range(0, len(start), AT_ONCE):
                    part = slice(i, i + AT_ONCE)
                    np.add.at(total, text[part], net.probabilities(as_windows(data, start[part], size[part])) * size[part, None])
                total /= np.maximum(np.diff(offsets), 1)[:, None]
                best = total.argmax(axis=1)
                lang[known] = np.array(net.langs, dtype=object)[best[known]]
                score[known] = np.clip(total[np.arange(n), best], 0, 1)[known]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, F.col("text").alias("text_"), letters.alias("letters_")).mapInArrow(fn, schema)


def fit(docs: DataFrame) -> Network | None:
    """Train on a bounded sample of the documents that are not held out."""
    rows = sample(docs)
    return train(rows) if rows else None


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text of ``docs``.

    Learns from ``lang`` of documents that are not held out; no column but the
    text is an input of a prediction.  Null doc_ids are not held out.  Repeated
    rows and ties get the same answer; an empty table gives no row.  Other
    columns are not read, whatever their names.
    """
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs, fit(docs), ["doc_id", "held_out"])


#: A document is rejected if no language reaches this mean probability.
LEAST_SCORE = 0.35


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents of ``docs``, in their own columns (of any names), whose language is found."""
    found = predict(boxed(docs, "text"), fit(docs), ["box_", "text"])
    return unboxed(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns, "text")


def op5(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document of the table."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
