"""Secret scans: three base patterns, and formats inferred as probabilistic automata from labelled credentials.

The base finds of all documents are the labelled credentials. They are split by kind and by the characters used, and
each part trains one automaton; the plain words of all documents, which are too short to be candidates, train one of
ordinary strings. An automaton's states come from how often the symbols' beginnings stand in all different strings
(those of at least one in `RARE`, so their number is bounded), its probabilities from the steps of all of them, counted.
Every candidate, a run of at least `CANDIDATE`
credential characters that no base span touches, and each of its parts between `=`, `/` and `.` that is long enough, is scored:
its best format likelihood against the ordinary one, in nats. The margin comes from counted scores of all base finds held out
of the training (a fifth, by hash) and of plain words joined to candidates' lengths. The method only adds spans.

Defined results: a null text is the empty text; spans are code points, end exclusive, of the whole match; letters of
the assign keywords match in either ASCII case; repeated rows get the same spans; spans of different kinds may
overlap and are all kept; with no credential to learn from, no span is added; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .grammar import DIGITS, LOWER, UPPER, Alphabet, Automaton, Classes, paths_of, pattern

#: Fixed patterns of the base finds and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_ASSIGN = 6
_KEYWORDS = ("passw", "secret", "token", "api")
#: Shortest candidate; share of strings below which a beginning is not followed; symbols of the longest beginning that may be a state of its own
#: (every string's steps are counted to its end all the same, in the states that they lead to); different words that a task gathers before it
#: sends them, and their characters; words of a bucket that are joined, and steps of a nat.
CANDIDATE, RARE, DEEPEST, PARTIAL, PARTIAL_CHARS, BUCKET, STEPS = 16, 1024, 200, 50_000, 1 << 20, 4096, 64
#: Values from which a shape has an automaton of its own; least margin in nats; share of plain strings below the margin.
SHAPE_VALUES, MARGIN, PLAIN = 8, 8.0, 0.9995
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{CANDIDATE},}}")
_PART = re.compile(rf"[A-Za-z0-9+_-]{{{CANDIDATE},}}")
_RUN, _MARKS = re.compile(r"[A-Za-z0-9+/_.=-]+"), re.compile(r"[+/_.=-]+")
#: Characters of the shapes of values, the narrowest first.
SHAPES = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": DIGITS + LOWER, "upper": DIGITS + UPPER, "any": DIGITS + LOWER + UPPER}


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base finds, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return found


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters that no base span touches, outer marks left off; both lists are swept once."""
    found, base, at = [], sorted((a, b) for _, a, b, _ in taken), 0
    reach = 0  # the furthest end of the base spans that start before the candidate's end
    for m in _CANDIDATE.finditer(text):
        value = m.group().strip(".=-_/+")
        start = m.start() + len(m.group()) - len(m.group().lstrip(".=-_/+"))
        end = start + len(value)
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][1])
            at += 1
        if len(value) >= CANDIDATE and reach <= start:
            found.append((start, end, value))
    return found


def plain_words(text: str) -> list[str]:
    """Runs of credential characters too short to be candidates, and the parts of hosts and paths."""
    return [w for run in _RUN.findall(text) for w in ([run] if len(run) < CANDIDATE else _MARKS.split(run)) if 3 <= len(w) < CANDIDATE]


def shape(value: str) -> str:
    """The narrowest set of letters and digits that a value keeps to; other marks do not count."""
    used = {c for c in value if c.isalnum()}
    return next((k for k, letters in SHAPES.items() if used <= set(letters)), "any")


@dataclass
class Formats:
    automata: dict[tuple[str, str], Automaton]
    ordinary: list[Automaton]
    margin: float

    def score(self, value: str) -> float:
        """The best format's log-likelihood less the ordinary one's."""
        return max(a.log_likelihood(value) for a in self.automata.values()) - max(a.log_likelihood(value) for a in self.ordinary)

    def secret(self, value: str) -> bool:
        return self.score(value) > self.margin

    def spans(self, start: int, end: int, value: str) -> list[tuple[int, int]]:
        """The candidate, or those of its parts, that look like a format more than like ordinary text."""
        if self.secret(value):
            return [(start, end)]
        parts = [(start + m.start(), start + m.end()) for m in _PART.finditer(value) if m.end() - m.start() < len(value)]
        return [(a, b) for a, b in parts if self.secret(value[a - start : b - start])]


#: What a value is for: the automata's training, or the margin.
FIT, HELD, SCHEMA = "fit", "held", "group string, use string, value string"
#: Numbers of any length are plain, too.
NUMBERS = ["".join(str(n * n)[-3:] for n in range(k, k + k % 9 + 1)) for k in range(101, 501)]


def joined_words(words: list[str]) -> list[str]:
    """Plain words joined as paths, hosts and names are, up to candidates' lengths."""
    found, mark = [], "-._/"
    for k in range(0, len(words) - 6, 2):
        word = words[k]
        for j in range(1, 6):
            if len(word) >= CANDIDATE:
                break
            word += (mark[(k + j) % 4] if k % 3 else "") + words[k + j]
        found.append(word)
    return found


def strings_of(df: DataFrame) -> DataFrame:
    """kind, value: the different base finds and plain words of all documents."""
    runtime.ship(df.sparkSession)

    def run(batches):
        found: set[tuple[str, str]] = set()
        size = 0

        def out():
            kinds, values = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

        for batch in batches:
            for part in runtime.slices(batch):
                for text in filter(None, part.column("text").to_pylist()):
                    base = base_spans(text)
                    found.update((k, v) for k, _, _, v in base)
                    size += sum(len(v) for *_, v in base)
                    found.update(("plain", w) for w in plain_words(text))
                    if len(found) >= PARTIAL or size >= PARTIAL_CHARS:
                        yield out()
                        size = 0
        yield out()

    return df.select("text").mapInArrow(run, "kind string, value string").distinct()


def counted(df: DataFrame, schema: str, work) -> DataFrame:
    """The summed n of the keys in the schema; work adds the keys of a batch to a Counter, which a task sends when it is full."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64() if f.endswith("bigint") else pa.string() for f in schema.split(", ")]

    def run(batches):
        found: Counter = Counter()

        def out():
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            arrays = [*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(list(found.values()), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "n"])

        for batch in batches:
            for part in runtime.slices(batch):
                work(part, found)
                if len(found) >= PARTIAL:
                    yield out()
        yield out()

    return df.mapInArrow(run, f"{schema}, n bigint").groupBy(*names).agg(F.sum("n").alias("n"))


def with_shapes(found: DataFrame, where: str = "kind <> 'plain'") -> DataFrame:
    """group, use, value: base finds by kind and shape, a fifth of them held out; plain words are a group of their own."""

    def part(batch: pa.RecordBatch) -> dict:
        kinds, values = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
        use = [HELD if k != "plain" and xxhash.xxh32_intdigest(v.encode()) % 5 == 0 else FIT for k, v in zip(kinds, values, strict=True)]
        return {"group": [k if k == "plain" else f"{k} {shape(v)}" for k, v in zip(kinds, values, strict=True)], "use": use, "value": values}

    return runtime.per_batch(found.where(where), SCHEMA, part, ["kind", "value"])


def with_joined(found: DataFrame) -> DataFrame:
    """with_shapes of all strings, and plain words joined within buckets of like hashes, every second one held out."""

    def join(batches):
        bucket, words = None, []

        def out():
            made = joined_words(words)
            uses = [(FIT, HELD)[k % 2] for k in range(len(made))]
            return pa.RecordBatch.from_arrays([pa.array(["plain"] * len(made), pa.string()), pa.array(uses, pa.string()), pa.array(made, pa.string())], names=["group", "use", "value"])

        for batch in batches:
            for b, word in zip(batch.column("bucket").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if b != bucket:
                    if words:
                        yield out()
                    bucket, words = b, []
                words.append(word)
        if words:
            yield out()

    plain = found.where("kind = 'plain'")
    mixed = F.xxhash64("value", F.lit(7))
    keyed = plain.select(F.pmod(mixed, F.lit(max(1, plain.count() // BUCKET))).alias("bucket"), mixed.alias("h"), "value")
    made = keyed.repartition("bucket").sortWithinPartitions("bucket", "h", "value").select("bucket", "value").mapInArrow(join, SCHEMA)
    return with_shapes(found, "true").unionAll(made)


def beginnings(values: DataFrame, sizes: dict[str, int], common: float = 0.95) -> dict[str, str]:
    """By group what (nearly) all of its values begin with, from two counts over all of them.

    The first finds, for each of the first `DEEPEST` places, the character that nearly all values have there: a common
    beginning can only consist of these. The second counts the values that begin with each such beginning and go on.
    """
    going = {g for g, n in sizes.items() if n >= 4}

    def places(batch, found):
        for g, v in zip(batch.column("group").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if g in going:
                found.update([(g, k, c) for k, c in enumerate(v[:DEEPEST])])

    usual: dict[str, dict[int, str]] = {g: {} for g in going}
    for r in counted(values, "group string, place bigint, c string", places).collect():
        if r["n"] >= common * sizes[r["group"]]:
            usual[r["group"]][r["place"]] = r["c"]
    longest = {g: "".join(at[k] for k in range(next((k for k in range(len(at)) if k not in at), len(at)))) for g, at in usual.items()}

    def shared(batch, found):
        for g, v in zip(batch.column("group").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if g in going:
                same = next((k for k, (a, b) in enumerate(zip(longest[g], v)) if a != b), min(len(longest[g]), len(v)))
                found[g, min(same, len(v) - 1)] += 1

    prefix = dict.fromkeys(sizes, "")
    reached: dict[str, Counter] = {g: Counter() for g in going}
    for r in counted(values, "group string, same bigint", shared).collect():
        reached[r["group"]][r["same"]] = r["n"]
    for g, by in reached.items():
        for k in range(len(longest[g]), 0, -1):
            if sum(n for same, n in by.items() if same >= k) >= common * sizes[g]:
                prefix[g] = longest[g][:k]
                break
    return prefix


def automata_of(values: DataFrame, symbols: dict[str, Alphabet | Classes]) -> dict[str, Automaton]:
    """By group the automaton of all its values: states from the beginnings that are not rare, probabilities from every step."""

    def patterns(batch, found):
        for g, v in zip(batch.column("group").to_pylist(), batch.column("value").to_pylist(), strict=True):
            symbol = symbols[g]
            own = pattern(symbol, v)
            found[g, own, ""] += 1
            found.update([(g, k, c) for k, c in zip(own, v, strict=True)])

    every = runtime.checkpoint(counted(values, "group string, symbols string, c string", patterns))
    chars: dict[str, Counter] = {g: Counter() for g in symbols}
    for r in every.where("c <> ''").collect():
        chars[r["group"]][r["symbols"], r["c"]] = r["n"]
    kept = every.where("c = ''")
    total = {r["group"]: r["total"] for r in kept.groupBy("group").agg(F.sum("n").alias("total")).collect()}

    def paths(batch, found):
        for g, own, n in zip(*(batch.column(c).to_pylist() for c in ("group", "symbols", "n")), strict=True):
            for path, through, ends in paths_of([(own, n)], DEEPEST):
                found[g, path, "through"] += through
                found[g, path, "ends"] += ends

    least = F.create_map(*[F.lit(x) for g, n in total.items() for x in (g, n)])[F.col("group")] if total else F.lit(0)
    counts = counted(kept, "group string, path string, what string", paths).groupBy("group", "path")
    counts = counts.agg(*[F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w) for w in ("through", "ends")])
    seen: dict[str, dict[str, tuple[int, int]]] = {g: {} for g in total}
    for r in counts.where(F.col("through") * RARE >= least).collect():
        seen[r["group"]][r["path"]] = r["through"], r["ends"]
    found = {g: Automaton.of_counts(symbols[g], chars[g], seen[g]) for g in sorted(total)}

    def steps(batch, counter):
        for g, own, n in zip(*(batch.column(c).to_pylist() for c in ("group", "symbols", "n")), strict=True):
            for q, k in found[g].walk(own):
                counter[g, q, k] += n

    walked: dict[str, dict[tuple[int, str], int]] = {g: {} for g in found}
    for r in counted(kept, "group string, state bigint, symbol string", steps).collect():
        walked[r["group"]][r["state"], r["symbol"]] = r["n"]
    for g, automaton in found.items():
        automaton.recount(walked[g])
    return found


def at_rank(counts: dict[int, int], rank: int) -> int:
    """The key that stands at a rank of counted keys in order."""
    for key in sorted(counts):
        rank -= counts[key]
        if rank < 0:
            return key
    raise ValueError("no such rank")


def train(df: DataFrame) -> Formats | None:
    """Formats from the base finds and plain words of all documents; counts of bounded number reach the driver."""
    strings = runtime.checkpoint(strings_of(df))
    sizes = {r["group"]: r["count"] for r in with_shapes(strings).groupBy("group").count().collect()}
    if not sizes:
        return None
    few = {g for g, n in sizes.items() if n < SHAPE_VALUES}
    named = lambda g: f"{g.split()[0]} any" if g in few else g
    whole: Counter = Counter()
    for g, n in sizes.items():
        whole[named(g)] += n
    values = with_joined(strings)
    renamed = F.when(F.col("group").isin(sorted(few)), F.concat(F.substring_index("group", " ", 1), F.lit(" any"))).otherwise(F.col("group"))
    # A group of few values keeps none for the margin.
    small = F.col("group").isin(sorted(g for g, n in whole.items() if n < SHAPE_VALUES))
    values = runtime.checkpoint(values.withColumn("group", renamed).withColumn("use", F.when(small, F.lit(FIT)).otherwise(F.col("use"))))
    fit = values.where(F.col("use") == FIT)
    of_fit = {r["group"]: r["count"] for r in fit.where("group <> 'plain'").groupBy("group").count().collect()}
    begins = beginnings(fit.where("group <> 'plain'"), of_fit)
    symbols: dict[str, Alphabet | Classes] = {g: Alphabet(begins[g], SHAPES[g.split()[1]]) for g in of_fit} | {"plain": Classes()}
    automata = automata_of(fit, symbols)
    plain = automata.pop("plain", None) or Automaton(["ordinary", "text", "with", "nothing", "in", "it"], Classes())
    formats = Formats({tuple(g.split()): a for g, a in automata.items()}, [plain, Automaton(NUMBERS, Classes())], MARGIN)
    if not formats.automata:
        return None

    def scores(batch, found):
        for g, v in zip(batch.column("group").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if len(v) >= CANDIDATE:
                found["plain" if g == "plain" else "secret", math.floor(formats.score(v) * STEPS)] += 1

    by: dict[str, Counter] = {"plain": Counter(math.floor(formats.score(v) * STEPS) for v in NUMBERS if len(v) >= CANDIDATE), "secret": Counter()}
    for r in counted(values.where(F.col("use") == HELD), "what string, step bigint", scores).collect():
        by[r["what"]][r["step"]] += r["n"]
    high = (at_rank(by["plain"], int(PLAIN * (by["plain"].total() - 1))) + 1) / STEPS + 1
    # Between the two, nearer to the plain strings; never so high that a twentieth of the held-out values is missed.
    formats.margin = max(MARGIN, high)
    if by["secret"]:
        formats.margin = max(MARGIN, min(formats.margin, at_rank(by["secret"], by["secret"].total() // 20) / STEPS - 1))
    return formats


def spans_of(text: str | None, formats: Formats | None) -> list[tuple[str, int, int]]:
    """All spans of a whole text: the base ones and those that the formats add, by start, then kind."""
    text = text or ""
    found = base_spans(text)
    if formats is not None:
        found = found + [("format", a, b, "") for candidate in candidates(text, found) for a, b in formats.spans(*candidate)]
    return sorted(((k, a, b) for k, a, b, _ in found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(df: DataFrame, formats: Formats | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the spans of every text, by start, then kind as listed in KINDS."""
    keep = list(keep)
    source = runtime.unused(keep, "text")
    shared = df.sparkSession.sparkContext.broadcast(formats)
    schema = runtime.kept_and(df, keep, f"found {SPANS}")

    def work(batch: pa.RecordBatch) -> dict:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, shared.value)] for t in batch.column(source).to_pylist()]
        return {c: batch.column(c) for c in keep} | {"found": found}

    return runtime.per_batch(df.select(*map(runtime.quoted, keep), F.col("text").alias(source)), schema, work, [*keep, source])


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(df: DataFrame, formats: Formats | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format of every document."""
    found = scan(df, formats)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "format")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count("format").alias("n_format"),
    )


def masked(text: str | None, formats: Formats | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span replaced; overlapping spans are replaced together."""
    if text is None:
        return None
    out, at = [], 0
    for _, a, b in spans_of(text, formats):
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def mask(df: DataFrame, formats: Formats | None) -> DataFrame:
    """The rows with secrets masked in text and n_chars counted anew; other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(formats)
    columns = df.columns

    def work(batch: pa.RecordBatch) -> dict:
        texts = [masked(t, shared.value) for t in batch.column("text").to_pylist()]
        out = {c: batch.column(c) for c in columns} | {"text": texts}
        if "n_chars" in columns:
            out["n_chars"] = [n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)]
        return out

    return runtime.per_batch(df, df.schema, work, columns)
