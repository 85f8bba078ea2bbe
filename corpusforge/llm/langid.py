"""Language ID: a bidirectional gated recurrent network over bytes labels every position; a document pools them.

Every byte of the whole text is read. A long text is stepped through in segments side by side; a segment starts from
the states that the bytes before and behind it leave, and is read again from the neighbour's own state wherever that
differs by more than `SETTLED`: the labels are those of one pass over the whole text. The document's language is the one
with the greatest mean probability over its positions. Learning uses text and lang only, of a bounded sample
(`FIT_ROWS`, the smallest hashes of doc_id) of the documents that are not held out; one more class is learnt from
letters in no learnt language (the sample's own with their letters in random order, and letters of other scripts).

The filter rejects a document without letters, and one in which that class has a greater share than in nearly all
(`SURE`) of the documents that may be learnt from, and at least half: their shares are counted over all of them, whole.

Defined results: a null text, or one with no letter (Unicode category L), is `und` with score 0; with no labelled
document to learn from, every text is `und`; ties take the first language in order; repeated rows get the same result;
null doc_ids are never learnt from and count as not held out; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .bigru import BiGru

#: Documents learnt from, at most; the network's units a direction; steps of training, lanes and bytes of a step.
FIT_ROWS, HIDDEN, STEPS, LANES, BYTES = 3000, 8, 300, 128, 64
#: A longer document is learnt from through so many windows of so many characters, spread evenly over all of it, so that what reaches the driver is bounded.
WINDOWS, WINDOW = 5, 400
#: Bytes of a segment, bytes read before it to find its first state, segments that step together, and the
#: difference of a state beyond which a segment is read again.
SEGMENT, WARM, TOGETHER, SETTLED = 512, 96, 768, 0.02
#: Share of the documents that the filter's threshold lets through, the least threshold, and steps of the counted shares.
SURE, REJECT_FROM, SHARES = 0.998, 0.5, 1 << 16

_LETTER = regex.compile(r"\p{L}")
#: Letters of other scripts, for the class of no learnt language.
_SCRIPTS = [range(0x391, 0x3C9), range(0x410, 0x44F), range(0x5D0, 0x5EA), range(0x627, 0x64A), range(0x905, 0x939), range(0x3041, 0x3096), range(0x4E00, 0x9FA5), range(0xAC00, 0xD7A3), range(0x61, 0x7B)]


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, rows: int = FIT_ROWS, steps: int = STEPS, hidden: int = HIDDEN, seed: int = 3) -> tuple[list[str], BiGru | None]:
    """The languages in order and the network, from labelled documents that are not held out."""
    return learn(sample_of(df, rows), steps, hidden, seed)


def learnt_from(df: DataFrame) -> DataFrame:
    """The documents that may be learnt from: with a key, a text and a language, not held out; of any length."""
    return df.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") > 0))


def sample_of(df: DataFrame, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """At most `rows` documents with their languages: the text, or of one longer than all windows its windows, one in each fifth of it.

    Where a window lies in its fifth is the hash's choice.
    """
    part = F.floor(F.length("text") / WINDOWS).cast("int")
    place = lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(part - WINDOW + 1, F.lit(1))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring("text", k * part + place(k) + 1, F.lit(WINDOW)))
    parts = F.when(F.length("text") <= WINDOWS * WINDOW, F.array("text")).otherwise(windows)
    sampled = runtime.bounded_sample(learnt_from(df).select("doc_id", parts.alias("parts"), "lang"), "doc_id", rows, "parts", "lang")
    return [(part, r["lang"]) for r in sampled for part in r["parts"] if part]


def no_language(rng: np.random.Generator, text: str) -> str:
    """Letters in no learnt language: the text's own in random order within its words, or those of another script."""
    if rng.random() < 0.5:
        return " ".join("".join(rng.permutation(list(w))) for w in text.split(" "))
    script = _SCRIPTS[rng.integers(len(_SCRIPTS))]
    return " ".join("".join(chr(script[k]) for k in rng.integers(0, len(script), rng.integers(1, 11))) for _ in range(24))


def learn(sample: list[tuple[str, str]], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 3) -> tuple[list[str], BiGru | None]:
    """The languages in order and the network, from texts with their languages; its last class is no learnt language."""
    languages = sorted({x for _, x in sample})
    if not languages:
        return [], None
    rng = np.random.default_rng(seed)
    by = [[np.frombuffer(t.encode(), np.uint8) for t, lang in sample if lang == x] for x in languages]
    by.append([np.frombuffer(no_language(rng, sample[rng.integers(len(sample))][0]).encode(), np.uint8) for _ in range(max(8, min(800, len(sample))))])

    def batches():
        for _ in range(steps):
            x, y = np.full((BYTES, LANES), 256, np.int64), np.arange(LANES) % len(by)
            mask = np.zeros((BYTES, LANES), np.float32)
            for lane in range(LANES):
                data = by[y[lane]][rng.integers(len(by[y[lane]]))]
                at = rng.integers(0, max(1, len(data) - BYTES + 1))
                part = data[at : at + BYTES]
                x[: len(part), lane], mask[: len(part), lane] = part, 1
            yield x, y, mask

    network = BiGru(hidden, len(by), seed)
    network.fit(batches(), steps)
    return languages, network


def pooled(network: BiGru, texts: list[bytes], segment: int = SEGMENT) -> np.ndarray:
    """Mean probabilities (documents, classes) over all positions of each text."""
    parts = [(k, at, min(segment, len(t) - at)) for k, t in enumerate(texts) for at in range(0, len(t), segment)]
    n, h, warm = len(parts), network.hidden, min(WARM, segment)
    sums = np.zeros((n, network.classes))
    starts, ends = ({d: np.zeros((n, h), np.float32) for d in "fb"} for _ in range(2))
    first = np.array([at == 0 for _, at, _ in parts], bool)
    last = np.array([at + size == len(texts[k]) for k, at, size in parts], bool)

    def lanes(which):
        """Blocks of segments and their bytes (steps, lanes), the longest first, with the active lanes of each step."""
        which = sorted(which, key=lambda x: -x[1][2])
        for block in range(0, len(which), TOGETHER):
            group = which[block : block + TOGETHER]
            size = np.array([s for _, (_, _, s) in group])
            longest = int(size[0])
            raw = b"".join(texts[k][at : at + s].ljust(longest, b"\0") for _, (k, at, s) in group)
            x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(len(group), longest).T)
            active = (size[None, :] > np.arange(longest)[:, None]).sum(axis=1)
            yield np.array([i for i, _ in group]), x, active, size

    def read(which: np.ndarray):
        for i, x, active, size in lanes([(j, parts[j]) for j in which.tolist()]):
            states = {d: network.direction(d, x, start=np.ascontiguousarray(starts[d][i].T), active=active) for d in "fb"}
            ends["f"][i], ends["b"][i] = states["f"][-1].T, states["b"][0].T
            prob = network.labelled(states["f"], states["b"])
            if active[-1] < len(i):
                prob *= (np.arange(len(x))[:, None] < size)[:, None, :]
            sums[i] = prob.sum(axis=0, dtype=np.float64).T

    # First states: what the bytes next to a segment leave.
    for i, x, active, _ in lanes([(j, (k, at - warm, warm)) for j, (k, at, _) in enumerate(parts) if at]):
        starts["f"][i] = network.direction("f", x, active=active)[-1].T
    for i, x, active, _ in lanes([(j, (k, at + s, min(warm, len(texts[k]) - at - s))) for j, (k, at, s) in enumerate(parts) if not last[j]]):
        starts["b"][i] = network.direction("b", x, active=active)[0].T
    again = np.arange(n)
    while len(again):
        read(again)
        off = np.zeros(n, bool)
        for d, inner, neighbour in (("f", ~first, -1), ("b", ~last, 1)):
            at = np.flatnonzero(inner)
            wrong = at[np.abs(ends[d][at + neighbour] - starts[d][at]).max(axis=1, initial=0) > SETTLED]
            starts[d][wrong] = ends[d][wrong + neighbour]
            off[wrong] = True
        again = np.flatnonzero(off)
    total = np.zeros((len(texts), network.classes))
    np.add.at(total, np.array([k for k, _, _ in parts], np.int64), sums)
    return total / np.array([max(1, len(t)) for t in texts])[:, None]


def judged(texts: list[str | None], languages: list[str], network: BiGru | None) -> tuple[list[str], list[float], list[float]]:
    """The language and score of each text, and the share of the class of no learnt language (1 without letters)."""
    read = [k for k, t in enumerate(texts) if network is not None and t and _LETTER.search(t)]
    names, scores, none = ["und"] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
    if read:
        prob = pooled(network, [texts[k].encode() for k in read])
        for k, row in zip(read, prob, strict=True):
            best = int(np.argmax(row[: len(languages)]))
            names[k], scores[k], none[k] = languages[best], float(min(1.0, row[best])), float(row[len(languages)])
    return names, scores, none


def threshold(sample: list[tuple[str, str]], languages: list[str], network: BiGru | None) -> float:
    """The share of no learnt language from which the filter rejects: above that of nearly all of the sample's documents."""
    if network is None or not sample:
        return 1.0
    return max(REJECT_FROM, float(np.quantile(judged([t for t, _ in sample], languages, network)[2], SURE)))


def threshold_of(df: DataFrame, languages: list[str], network: BiGru | None, sure: float = SURE) -> float:
    """That threshold from all documents that may be learnt from: a step's edge at which the share `sure` of them stays."""
    if network is None:
        return 1.0

    def work(batch: pa.RecordBatch) -> dict:
        return {"step": np.ceil(np.array(judged(batch.column("text").to_pylist(), languages, network)[2]) * SHARES).astype(np.int64)}

    counts = sorted(runtime.per_batch(learnt_from(df), "step bigint", work, ["text"]).groupBy("step").count().collect())
    below, want = 0, sure * sum(r["count"] for r in counts)
    for r in counts:
        below += r["count"]
        if below >= want:
            return max(REJECT_FROM, r["step"] / SHARES)
    return 1.0


def predict(df: DataFrame, languages: list[str], network: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"

    def work(batch: pa.RecordBatch) -> dict:
        names, scores, _ = judged(batch.column("text").to_pylist(), languages, network)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

    return runtime.per_batch(df.select("doc_id", "text", held_out().alias("held_out")), schema, work, ["doc_id", "text", "held_out"])


def keep(df: DataFrame, languages: list[str], network: BiGru | None, reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents in a learnt language, with all their columns; with nothing learnt, all that have letters."""

    def verdict(batch: pa.RecordBatch) -> list[bool]:
        texts = batch.column("text").to_pylist()
        if network is None:
            return [bool(t and _LETTER.search(t)) for t in texts]
        names, _, none = judged(texts, languages, network)
        return [n != "und" and x <= reject_from for n, x in zip(names, none, strict=True)]

    return runtime.filtered(df, verdict, ["text"])
