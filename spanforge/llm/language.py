"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads the bytes of a whole text in both directions, white space and all, labels every position, and is
trained by backpropagation through time on positions' cross-entropy. A document's probabilities are the mean over all
its letter positions (A-Z, a-z and bytes over 127). To read many texts at once, a text is cut into stretches of STEP
bytes, and each is read with MARGIN more bytes on either side from which it takes its state: positions are labelled by
at least so many bytes of context, within words and across them, in any script.

The training sample is bounded: PER_CLASS documents of each language and WINDOWS stretches of TRAIN bytes of each
document, chosen by hashes, all from rows whose crc32(doc_id as text) mod 3 is not 1. Every language that has such a row
is learned.

Defined results: `und` with score 0 if the text is null or has no letter, or if there is nothing to learn from; null
lang rows are predicted but not learned from; a null doc_id is neither learned from nor held out; repeated rows give a
row each; an empty table gives no rows; extra columns stay in with_language(), where those of the two new names are
replaced, and are ignored in the query.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy

PER_CLASS, WINDOWS, TRAIN = 240, 6, 64
#: Steps of training at least: few labelled rows are read more often.
LEAST_STEPS = 500
HIDDEN = 12
STEP, MARGIN = 512, 16
#: Stretches that are read at once, and the bytes of texts that are held for it (a longer text is read alone).
WIDE, HELD = 512, 1 << 21
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ONE_HOT = np.eye(256, dtype=np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


class BiGru:
    """Bytes in, class probabilities of each position out. Arrays are (steps, features, texts)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"out": make(2 * hidden, classes, scale=0.2), "bias": np.zeros(classes, np.float32)}
        for d in "fb":
            self.w[f"in_{d}"] = make(256, 3 * hidden, scale=0.3)
            self.w[f"rec_{d}"] = make(3 * hidden, hidden, scale=0.3)

    def _direction(self, x: np.ndarray, d: str, sizes: np.ndarray | None, trace: list | None) -> np.ndarray:
        """States of all steps. sizes: of the texts, falling, if they differ; what follows a text's end has no state."""
        (steps, n), h = x.shape, self.hidden
        gates, rec = self.w[f"in_{d}"], self.w[f"rec_{d}"]
        kind = gates.dtype
        state, out = np.zeros((h, n), kind), np.empty((steps, h, n), kind)
        g, u = np.empty((n, 3 * h), kind), np.empty((3 * h, n), kind)
        alive = np.searchsorted(-sizes, -np.arange(steps), "left") if sizes is not None else None
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(gates, x[t], axis=0, out=g, mode="clip")
            np.matmul(rec, state, out=u)
            gt = g.T
            zr = u[: 2 * h] + gt[: 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            new = zr[h:] * u[2 * h :]
            new += gt[2 * h :]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((t, state, zr[:h], zr[h:], new, u[2 * h :].copy()))
            state = state - new
            state *= zr[:h]
            state += new
            if alive is not None and d == "b":
                state[:, alive[t] :] = 0
            out[t] = state
        return out

    def positions(self, x: np.ndarray, sizes: np.ndarray | None = None, trace: dict | None = None) -> np.ndarray:
        """Probabilities (steps, classes, texts) of the bytes x (steps, texts)."""
        h = self.hidden
        both = [self._direction(x, d, sizes, None if trace is None else trace.setdefault(d, [])) for d in "fb"]
        p = np.matmul(self.w["out"][:h].T, both[0])
        p += np.matmul(self.w["out"][h:].T, both[1])
        p += self.w["bias"][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        if trace is not None:
            trace["both"] = np.concatenate(both, 1)
        return p

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions of x (steps, texts), and its gradients through time."""
        trace: dict = {}
        p = self.positions(x, trace=trace)
        at, h = np.arange(x.shape[1]), self.hidden
        loss = float(-np.log(p[:, label, at] + 1e-9).mean())
        d_logits = p.copy()
        d_logits[:, label, at] -= 1
        d_logits /= p.shape[0] * p.shape[2]
        grads = {"out": np.einsum("thn,tcn->hc", trace["both"], d_logits, optimize=True), "bias": d_logits.sum((0, 2))}
        d_both = np.matmul(self.w["out"], d_logits)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            rec = self.w[f"rec_{d}"]
            g_in, g_rec = np.zeros_like(self.w[f"in_{d}"]), np.zeros_like(rec)
            carry = np.zeros((h, x.shape[1]), rec.dtype)
            for t, before, z, r, new, u in reversed(trace[d]):
                dh = d_both[t, part] + carry
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (before - new) * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r])
                g_in += _ONE_HOT[x[t]].T @ np.concatenate([d_z, d_r, d_new]).T
                g_rec += d_u @ before.T
                carry = dh * z + rec.T @ d_u
            grads[f"in_{d}"], grads[f"rec_{d}"] = g_in, g_rec
        return loss, grads

    def train(self, rows: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 11) -> float:
        """Adam over batches of rows of one length; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(rows):
            groups.setdefault(len(w), []).append(k)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        step, mean = 0, 0.0
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(rows), 1)) if len(rows) > batch else 20)
        for epoch in range(epochs):
            todo = [b for g in groups.values() for b in np.array_split(rng.permutation(g), -(-len(g) // batch))]
            losses, now = [], rate * (1 - epoch / (epochs + 1))
            for b in (todo[k] for k in rng.permutation(len(todo))):
                x = np.frombuffer(b"".join(rows[k] for k in b), np.uint8).reshape(len(b), -1).T.astype(np.intp)
                loss, grads = self.gradients(x, labels[b])
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    m = moments[k]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.99 * m[1] + 0.01 * g * g
                    self.w[k] -= (now * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean


def pooled(net: BiGru, texts: list[bytes], classes: int) -> np.ndarray:
    """Mean class probabilities of the letter positions of each text (zeros where there is none)."""
    cuts = [(k, s, min(s + STEP, len(b)), max(0, s - MARGIN), min(len(b), s + STEP + MARGIN)) for k, b in enumerate(texts) for s in range(0, len(b), STEP)]
    cuts.sort(key=lambda c: c[3] - c[4])
    total, count = np.zeros((len(texts), classes)), np.zeros(len(texts))
    wide = max(16, min(WIDE, (WIDE << 3) // classes))
    for i in range(0, len(cuts), wide):
        part = cuts[i : i + wide]
        sizes = np.array([c[4] - c[3] for c in part])
        x, counted = np.zeros((len(part), sizes[0]), np.uint8), np.zeros((len(part), sizes[0]), bool)
        for row, mask, (k, s, e, lo, hi) in zip(x, counted, part, strict=True):
            row[: hi - lo] = np.frombuffer(texts[k], np.uint8, hi - lo, lo)
            mask[s - lo : e - lo] = True
        counted &= _LETTER_BYTE[x]
        p = net.positions(x.T.astype(np.intp), sizes)
        owner = [c[0] for c in part]
        np.add.at(total, owner, np.einsum("tcn,nt->nc", p, counted.astype(p.dtype), optimize=True))
        np.add.at(count, owner, counted.sum(1))
    return total / np.maximum(count, 1)[:, None]


@tidy
def _pick(batches):
    """A bounded, hashed choice of stretches from all of each whole text."""
    for batch in batches:
        langs, picked = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            starts = range(0, max(1, len(raw) - TRAIN // 2), TRAIN)
            best = sorted(starts, key=lambda s: (xxhash.xxh64_intdigest(raw[s : s + TRAIN]), s))[:WINDOWS] if has_letter(text) else []
            langs.append(lang)
            picked.append([raw[s : s + TRAIN] for s in best])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(picked, pa.list_(pa.binary()))], ["lang", "rows"])


def _third(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def learnable(doc_id: Column) -> Column:
    return F.coalesce(_third(doc_id) != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_third(doc_id) == 1, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame) -> tuple[list[str], BiGru] | None:
    """(languages, network) from docs(doc_id, text, lang)."""
    usable = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return None
    # about twice the rows that are wanted of each language, so that their ranking is as small for any input
    share = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, (2 * PER_CLASS + 100) / r["n"])) for r in counts], "lang string, share double"))
    some = usable.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_CLASS).select("doc_id")
    # at most PER_CLASS ids a language
    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("lang", "text").mapInArrow(_pick, "lang string, rows array<binary>").collect()
    found = sorted((r["lang"], bytes(w)) for r in rows for w in r["rows"])
    if not found:
        return None
    net = BiGru(len(langs))
    place = {lang: k for k, lang in enumerate(langs)}
    net.train([w for _, w in found], np.array([place[lang] for lang, _ in found], np.int64))
    return langs, net


def with_language(spark: SparkSession, docs: DataFrame, model: tuple[list[str], BiGru] | None = None, fit_on: DataFrame | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (or other names) appended; only the text is an input of the prediction."""
    docs = docs.drop(*names)
    model = model or fit(spark, docs if fit_on is None else fit_on)
    langs, weights = (model[0], model[1].w) if model else ([], {})
    said = spark.sparkContext.broadcast(weights)  # of one fixed size for a number of classes

    @tidy
    def run(batches):
        net = BiGru(max(len(langs), 1))
        net.w = said.value or net.w
        for batch in batches:
            preds, scores = [], []
            texts, at = batch.column("text"), 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and (not part or size < HELD):
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                known = [bool(langs) and has_letter(t) for t in part]
                p = pooled(net, [t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(part, known, strict=True)], max(len(langs), 1))
                best = p.argmax(1)
                preds += [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores += [float(min(1.0, p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def op6_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = with_language(spark, docs.select("doc_id", "text"), fit_on=docs)
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
