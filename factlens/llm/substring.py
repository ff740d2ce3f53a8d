"""Operator 5: removal of passages that an earlier document has, located by Aho-Corasick automata.

A window is SPAN consecutive words. A word goes if a window over it also starts in a document with a smaller id.

1. Each window names its phrase: of the PHRASE-word runs in it, the one with the smallest hash (the first of equals). Equal
   windows name equal phrases, and some 5 in 100 places are named. Consecutive windows with the same phrase form a run. A
   table of (phrase, hash of the run's words) with the smallest and largest document of each bucket of documents, and the
   place of the phrase in the smallest, confirms the phrases that recur, and finds for each run the first document that has it.
2. Each bucket (BUCKET_BYTES of text on average) compiles its confirmed phrases into an automaton and streams its documents
   through it. What the automaton locates is all that is looked at: around each place of a phrase the windows that name it
   form a run. A run that an earlier document has too is settled at once: all its windows go. If the phrase recurs in other
   surroundings, the run's windows are put into a table of their own, hash by hash.
3. That table gives each window's first document, and the documents that wait for it are finished.

Hot passages are summed by bucket, and phrases, runs and windows by their hash, before they are shuffled; what was found of
each is joined back with hot ones dealt over tasks (common.dealt_join), so no task holds a group. A run is told by 128 bits
(64 of its phrase, 64 of all its words), a window by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, importable, written

SPAN, PHRASE, BUCKET_BYTES = 50, 12, 3 << 20
_B = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        b = int(_B[which])
        _POWERS[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (b, pow(b, -1, 1 << 64)))
    up, down = _POWERS[which]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Hashes:
    """Hashes of any stretch of a row of words."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        h = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)
        self.sums, self.down = [], []
        for which, x in enumerate((h, _mix(h + np.uint64(0x5851F42D4C957F2D)))):
            up, down = _powers(which, self.n + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: self.n], dtype=np.uint64)]))
            self.down.append(down)

    def of(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[stop] - s[start]) * self.down[which][start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(words: list[bytes], lengths: np.ndarray, span: int = SPAN, phrase: int = PHRASE) -> pd.DataFrame:
    """Of documents that lie one after another: doc, at (the phrase's word in its document), h (the phrase's hash), r (the run's)."""
    hashes, n = Hashes(words), len(words)
    empty = pd.DataFrame({c: np.empty(0, np.int64) for c in ("doc", "at", "h", "r")})
    if n < span:
        return empty
    i = np.arange(n - phrase + 1)
    low = hashes.of(i, i + phrase, 0)
    grams, where, have, width = low, i, 1, span - phrase + 1
    while have < width:  # smallest of `have` phrases from each place on, the leftmost of equals
        step = min(have, width - have)
        a, b = low[:-step], low[step:]
        right = b < a
        low, where = np.where(right, b, a), np.where(right, where[step:], where[:-step])
        have += step
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + span <= ends[doc])
    if not len(at):
        return empty
    d, p = doc[at], where[at]
    head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]))
    first, last = at[head], at[np.concatenate([head[1:], [len(at)]]) - 1]
    d, p = d[head], p[head]
    return pd.DataFrame({"doc": d, "at": p - (ends - lengths)[d], "h": grams[p].view(np.int64), "r": hashes.of(first, last + span, 1).view(np.int64)})


def runs_at(hashes: Hashes, places: np.ndarray, doc: np.ndarray, lengths: np.ndarray, span: int = SPAN, phrase: int = PHRASE) -> pd.DataFrame:
    """The runs of the phrases at these places (of the documents that lie one after another): doc, h, r, and first and last, the
    window starts. A place that no window names has none."""
    ends = np.cumsum(lengths)
    start, stop, width = (ends - lengths)[doc], ends[doc], span - phrase + 1
    hash_at = lambda q: hashes.of(q, q + phrase, 0)
    h = hash_at(places)
    first, last = np.maximum(start, places - width + 1), np.minimum(places, stop - span)
    for d in range(1, width):  # up to the nearest phrase that a window would name instead
        q = np.flatnonzero(places - d >= first)
        q = q[hash_at(places[q] - d) <= h[q]]
        first[q] = places[q] - d + 1
        q = np.flatnonzero((places + d + phrase <= stop) & (places + d - width < last))
        q = q[hash_at(places[q] + d) < h[q]]
        last[q] = places[q] + d - width
    ok = first <= last
    first, last = first[ok], last[ok]
    return pd.DataFrame({"doc": doc[ok], "h": h[ok].view(np.int64), "r": hashes.of(first, last + span, 1).view(np.int64), "first": first, "last": last})


def _batched(ids: list, texts: list, size: int = 256) -> Iterator[tuple[list, list[list[bytes]], np.ndarray]]:
    for at in range(0, len(ids), size):
        words = [words_of(t) for t in texts[at : at + size]]
        yield ids[at : at + size], words, np.array([len(w) for w in words], dtype=np.int64)


def _name_phrases(span: int, phrase: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, words, lengths in _batched(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                r = runs([w for x in words for w in x], lengths, span, phrase).drop_duplicates(["doc", "h", "r"])
                doc = pa.array(r["doc"].to_numpy() + at)
                at += len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), pa.array(r["h"]), pa.array(r["r"]), batch.column(1).take(doc), pa.array(r["at"].to_numpy().astype(np.int32))], schema=schema)

    return run


class Locator:
    """One automaton over a bucket's phrases."""

    def __init__(self, phrases: list[bytes]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            self.machine.add_word((b" " + p + b" ").decode("latin-1"), (i, len(p) + 1))
        self.machine.make_automaton()

    def places(self, words: list[bytes]) -> np.ndarray:
        """The words at which a phrase starts."""
        hits = [end - length for end, (_, length) in self.machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1"))]
        if not hits:
            return np.empty(0, np.int64)
        return np.searchsorted(np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]), np.sort(hits))


def _finish(words: list[bytes], spans: list[tuple[int, int]], with_text: bool) -> tuple[int, int, str, list[dict], str | None]:
    """spans: first and last window starts, and the window's words go with each."""
    mark = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        mark[a] += 1
        mark[b] -= 1
    gone = np.cumsum(mark)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    cut = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    kept, at = [], 0
    for a, b in [*cut, (len(words), len(words))]:
        kept.extend(words[at:a])
        at = b
    text = b" ".join(kept)
    return len(words), int(gone.sum()), hashlib.sha256(text).hexdigest(), [{"start": a, "stop": b} for a, b in cut], text.decode("utf-8", "surrogatepass") if with_text else None


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, phrase: int = PHRASE, with_text: bool = False, carry: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word ranges), and, if asked for, kept (the words left, joined by one
    blank) and the columns of carry.

    Ids may be of any type that has an order. A null, empty or white-space text has no words. Texts of fewer words than a
    window keep them all. A row without an id keeps all its words and is no source. Rows with the same id are compared with
    smaller ids only, so repeated rows do not remove each other. Texts of any length are read whole. No rows give no rows.
    Columns not named are not read. Rows that are alike in id and text are in one bucket.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-held // bucket_bytes) or 1)).cast("int"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_schema(spark.createDataFrame([], f"doc_id {kind}").schema).field(0).type
    seen = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("r", pa.int64()), ("doc", id_type), ("at", pa.int32())])
    named = rows.where(F.col("doc_id").isNotNull()).select("bucket", "doc_id", "text").mapInArrow(_name_phrases(span, phrase, seen), f"bucket int, h long, r long, doc {kind}, at int")
    named = written(named.groupBy("bucket", "h", "r").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min_by("at", "doc").alias("at")), "repeat-phrases")
    shared = named.groupBy("h").agg(F.min("lo").alias("h_lo"), F.max("hi").alias("h_hi"), (F.min("r") < F.max("r")).alias("many_runs"), F.count("*").alias("many")).where("h_lo < h_hi")
    shared = written(shared.select("h", "many_runs", "many"), "repeat-shared")
    facts = written(dealt_join(named, shared.drop("many"), "h", counts=shared.select("h", "many")), "repeat-facts")
    of_run = facts.groupBy("h", "r").agg(F.min("lo").alias("run_lo"), F.count("*").alias("many"))
    facts = dealt_join(facts, of_run.drop("many"), ["h", "r"], counts=of_run.drop("run_lo")).select("bucket", "h", "r", "lo", "at", "run_lo", "many_runs")
    extra = [f for f in rows.schema.fields if f.name.startswith("c") and f.name[1:].isdigit()]
    carried = to_arrow_schema(spark.createDataFrame([], rows.select(*[f.name for f in extra]).schema).schema) if extra else pa.schema([])
    ranges = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("stop", pa.int32())]))
    final = [("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", ranges), ("kept", pa.string())]
    middle = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *final, ("w1", pa.int64()), ("w2", pa.int64()), ("lo", id_type), ("hi", id_type), ("text", pa.string()), ("settled", pa.binary()), ("open", pa.binary()), *carried])
    DONE, WINDOW, WAITS = 0, 1, 2

    def table(n: int, bucket: int, kind: int, columns: dict) -> pa.Table:
        return pa.table([columns[f.name] if f.name in columns else pa.array(np.full(n, kind), pa.int32()) if f.name == "kind" else pa.array(np.full(n, bucket), pa.int32()) if f.name == "bucket" else pa.nulls(n, f.type) for f in middle], schema=middle)

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if not left.num_rows:
            return middle.empty_table()
        bucket = left.column("bucket")[0].as_py()
        facts = right.select(["h", "r", "lo", "at", "run_lo", "many_runs"]).to_pandas()
        ids = left.column("doc_id").to_pylist()
        parts = list(_batched(ids, left.column("text").to_pylist()))
        shown: dict = {}  # where a document shows a phrase
        for h, doc, at in facts.drop_duplicates("h")[["h", "lo", "at"]].itertuples(index=False):
            shown.setdefault(doc, []).append((h, at))
        phrases = {}
        for chunk, words, _ in parts:
            for i, w in zip(chunk, words, strict=True):
                for h, at in shown.get(i, ()):
                    text = w[at : at + phrase]
                    if h not in phrases and len(text) == phrase and int(Hashes(text).of(np.array([0]), np.array([phrase]), 0).view(np.int64)[0]) == h:
                        phrases[h] = b" ".join(text)
        locator = Locator(list(phrases.values())) if phrases else None
        seen_at = 0
        for chunk, words, lengths in parts:
            n = len(chunk)
            spans: list[list] = [[] for _ in range(n)]
            waits: list[list] = [[] for _ in range(n)]
            starts = np.cumsum(lengths) - lengths
            places = [locator.places(w) if locator and i is not None and len(w) >= span else np.empty(0, np.int64) for i, w in zip(chunk, words, strict=True)]
            owner = np.repeat(np.arange(n), [len(p) for p in places])
            if len(owner):
                hashes = Hashes([w for x in words for w in x])
                r = runs_at(hashes, np.concatenate(places) + starts[owner], owner, lengths, span, phrase).merge(facts, on=["h", "r"], how="inner")
                base = starts[r["doc"].to_numpy()]
                for d, a, b, lo, many in zip(r["doc"], r["first"].to_numpy() - base, r["last"].to_numpy() - base, r["run_lo"], r["many_runs"], strict=True):
                    if lo < chunk[d]:
                        spans[d].append((a, b + span))
                    elif many:
                        waits[d].append((a, b))
                at = [np.arange(starts[d] + a, starts[d] + b + 1) for d in range(n) for a, b in waits[d]]
                if at:
                    waiting = np.repeat([d for d in range(n) for _ in waits[d]], [len(x) for x in at])
                    at = np.concatenate(at)
                    w = pd.DataFrame({"w1": hashes.of(at, at + span, 0).view(np.int64), "w2": hashes.of(at, at + span, 1).view(np.int64), "doc": [chunk[d] for d in waiting]})
                    w = w.groupby(["w1", "w2"], sort=False)["doc"].agg(["min", "max"]).reset_index()
                    out.append(table(len(w), bucket, WINDOW, {"w1": pa.array(w["w1"]), "w2": pa.array(w["w2"]), "lo": pa.array(w["min"].tolist(), id_type), "hi": pa.array(w["max"].tolist(), id_type)}))
            rest = left.slice(seen_at, n)
            seen_at += n
            keep = [k for k in range(n) if not waits[k]]
            more = {f.name: rest.column(f.name) for f in carried}
            done = list(zip(*[_finish(words[k], spans[k], with_text) for k in keep], strict=True)) or [[]] * 5
            cols = {name: pa.array(v, t) for (name, t), v in zip(final[1:], done, strict=True)}
            pick = pa.array(keep, pa.int64())
            out.append(table(len(keep), bucket, DONE, cols | {"doc_id": rest.column("doc_id").take(pick)} | {c: v.take(pick) for c, v in more.items()}))
            late = [k for k in range(n) if waits[k]]
            pick = pa.array(late, pa.int64())
            pack = lambda x: np.array(x, dtype="<i4").tobytes()
            out.append(table(len(late), bucket, WAITS, {"doc_id": rest.column("doc_id").take(pick), "text": rest.column("text").take(pick), "settled": pa.array([pack(spans[k]) for k in late], pa.binary()), "open": pa.array([pack(waits[k]) for k in late], pa.binary())} | {c: v.take(pick) for c, v in more.items()}))
        return pa.concat_tables([t.cast(middle) for t in out])

    located = written(rows.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(locate, from_arrow_schema(middle)), "repeat-runs")
    windows = located.where(F.col("kind") == WINDOW).select("bucket", "w1", "w2", "lo", "hi")
    firsts = written(windows.groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.count("*").alias("many")).where("first < last"), "repeat-windows")
    windows = dealt_join(windows.select(F.col("bucket").alias("of_bucket"), "w1", "w2"), firsts.select("w1", "w2", "first"), ["w1", "w2"], counts=firsts.select("w1", "w2", "many"))
    last = pa.schema([*final, *carried])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        w = right.select(["w1", "w2", "first"]).to_pandas()
        first = dict(zip(zip(w["w1"], w["w2"], strict=True), w["first"], strict=True))
        done = []
        for me, text, settled, waits in zip(*(left.column(c).to_pylist() for c in ("doc_id", "text", "settled", "open")), strict=True):
            words = words_of(text)
            hashes = Hashes(words)
            spans = np.frombuffer(settled, "<i4").reshape(-1, 2).tolist()
            for a, b in np.frombuffer(waits, "<i4").reshape(-1, 2).tolist():
                at = np.arange(a, b + 1)
                h1, h2 = (hashes.of(at, at + span, k).view(np.int64).tolist() for k in (0, 1))
                spans += [(i, i + span) for i, x, y in zip(at.tolist(), h1, h2, strict=True) if first.get((x, y), me) < me]
            done.append(_finish(words, spans, with_text))
        cols = list(zip(*done, strict=True)) or [[]] * 5
        return pa.table([left.column("doc_id"), *(pa.array(v, t) for (_, t), v in zip(final[1:], cols, strict=True)), *(left.column(f.name) for f in carried)], schema=last)

    waiting = located.where(F.col("kind") == WAITS).select("bucket", "doc_id", "text", "settled", "open", *carried.names)
    ended = waiting.groupBy("bucket").cogroup(windows.groupBy("of_bucket")).applyInArrow(finish, from_arrow_schema(last))
    out = located.where(F.col("kind") == DONE).select(*last.names).unionByName(ended)
    named_back = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "removed", *(["kept"] if with_text else []), *named_back)
