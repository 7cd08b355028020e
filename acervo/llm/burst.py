"""Frequency of every distinct term: burst-trie counting.

Each task counts its records in a burst trie: inner nodes branch on one character, leaves are
small containers {suffix: [occurrences, records]} that burst into a node when they grow. The
containers are written as compact rows (prefix, suffixes, counts). From their sizes the heavy
prefixes are found - those holding more than 1/ROUTES of all entries, so at most ROUTES of each
length - and every term is routed by its shortest prefix that isn't heavy, however long it is.
Subtrees of one route meet in one task and are merged there.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.latest import latest
from acervo.runtime import materialise

#: Entries a container holds before it bursts; entries a task holds before it writes its trie.
BURST, FLUSH = 512, 1_000_000
#: A prefix with more than one in ROUTES of all entries is split further; STEP characters are looked at first.
ROUTES, STEP = 256, 12
#: Entries in one row of a written container.
ROW = 2048

_COUNT = re.compile(r"[0-9]+")


class BurstTrie:
    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.size = burst, 0
        self.root: dict = {}
        self.ends: dict = {}  # terms that end at an inner node, by term

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while True:
            if depth == len(term):
                cell = self.ends.get(term)
                if cell is None:
                    self.ends[term] = [occurrences, records]
                    self.size += 1
                else:
                    cell[0] += occurrences
                    cell[1] += records
                return
            char = term[depth]
            depth += 1
            below = node.get(char)
            if below is None:
                below = node[char] = ({}, None)
            box, inner = below
            if inner is None:
                suffix = term[depth:]
                cell = box.get(suffix)
                if cell is not None:
                    cell[0] += occurrences
                    cell[1] += records
                    return
                box[suffix] = [occurrences, records]
                self.size += 1
                if len(box) > self.burst:
                    self._burst(node, char, term[:depth], box)
                return
            node = inner

    def _burst(self, node: dict, char: str, prefix: str, box: dict) -> None:
        inner: dict = {}
        for suffix, cell in box.items():
            if not suffix:
                self.ends[prefix] = cell
            else:
                inner.setdefault(suffix[0], ({}, None))[0][suffix[1:]] = cell
        node[char] = (None, inner)

    def containers(self) -> Iterator[tuple[str, list[tuple[str, list[int]]]]]:
        """(prefix, sorted entries) of every container; ended terms as containers of their own."""
        for term, cell in self.ends.items():
            yield term, [("", cell)]
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for char, (box, inner) in node.items():
                if inner is None:
                    yield prefix + char, sorted(box.items())
                else:
                    stack.append((prefix + char, inner))


def terms_of(lemmas: str | None, bow: str | None) -> Counter:
    """Terms of one record. Any Unicode whitespace separates; lower case, composed (NFC). The bag
    (`term|count`, the last bar separates) counts only where the text is null or blank; its entries
    without a term or a positive whole count are dropped, entries of one term add up."""
    if lemmas is not None and (tokens := unicodedata.normalize("NFC", lemmas.lower()).split()):
        return Counter(tokens)
    found: Counter = Counter()
    for entry in unicodedata.normalize("NFC", (bow or "").lower()).split():
        term, bar, count = entry.rpartition("|")
        if bar and term and _COUNT.fullmatch(count) and int(count) > 0:
            found[term] += int(count)
    return found


_PART = "prefix string, suffixes array<string>, occurrences array<long>, records array<long>, n_records long"
_PART_ARROW = pa.schema([("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64())), ("n_records", pa.int64())])


def _rows(trie: BurstTrie, n_records: int) -> Iterator[pa.RecordBatch]:
    rows: list = [("", [], [], [], n_records)]
    held = 0
    for prefix, entries in trie.containers():
        for at in range(0, len(entries), ROW):
            part = entries[at : at + ROW]
            rows.append((prefix, [s for s, _ in part], [c[0] for _, c in part], [c[1] for _, c in part], 0))
            held += len(part)
        if held > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PART_ARROW)], schema=_PART_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PART_ARROW)], schema=_PART_ARROW)


def _count(min_terms: int, burst: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, n = BurstTrie(burst), 0
        for batch in batches:
            for lemmas, bow in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(lemmas, bow)
                if found.total() < min_terms:
                    continue
                n += 1
                for term, count in found.items():
                    trie.add(term, count, 1)
            if trie.size > flush:
                yield from _rows(trie, n)
                trie, n = BurstTrie(burst), 0
        yield from _rows(trie, n)

    return run


def route_of(term: str, heavy: frozenset[str]) -> str:
    """The shortest prefix that isn't heavy (the whole term if all are)."""
    for n in range(1, len(term)):
        if term[:n] not in heavy:
            return term[:n]
    return term


def heavy_prefixes(sizes: DataFrame, most: float, step: int = STEP) -> frozenset[str]:
    """The prefixes of sizes(prefix, n) whose rows have more than `most` in all, of every length: `step`
    characters at first, and twice as many again below those of them that are heavy to the end."""
    found: set[str] = set()
    done, upto, roots = 0, step, None
    while True:
        rows = sizes if roots is None else sizes.join(F.broadcast(roots), F.substring("prefix", 1, done) == F.col("root")).drop("root")  # at most total / most rows
        cut = rows.where(F.length("prefix") > done).groupBy(F.substring("prefix", 1, upto).alias("prefix")).agg(F.sum("n").alias("n"))
        parts = F.transform(F.sequence(F.lit(done + 1), F.length("prefix")), lambda i: F.substring(F.col("prefix"), F.lit(1), i))
        heavy = [r.p for r in cut.select(F.explode(parts).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("p").collect()]  # at most total / most of each length
        found.update(heavy)
        ends = [p for p in heavy if len(p) == upto]
        if not ends:
            return frozenset(found)
        roots, done, upto = sizes.sparkSession.createDataFrame([(p,) for p in ends], "root string"), upto, 2 * upto


_ROUTED = "route string, prefix string, suffixes array<string>, occurrences array<long>, records array<long>"


def _split(heavy: frozenset[str]):
    """Containers above a cut are split by route; those below keep whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for row in batch.to_pylist():
                prefix, by = row["prefix"], {}
                if (at := route_of(prefix, heavy)) and at not in heavy and len(at) <= len(prefix):
                    out.append((at, prefix, row["suffixes"], row["occurrences"], row["records"]))
                    continue
                for s, o, r in zip(row["suffixes"], row["occurrences"], row["records"]):
                    part = by.setdefault(route_of(prefix + s, heavy), ([], [], []))
                    part[0].append(s), part[1].append(o), part[2].append(r)
                out += [(route, prefix, *part) for route, part in by.items()]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["route", "prefix", "suffixes", "occurrences", "records"])

    return run


def _merge(burst: int):
    names = ["term", "occurrences", "records"]

    def out(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        terms, occ, rec = [], [], []
        for prefix, entries in trie.containers():
            for s, (o, r) in entries:
                terms.append(prefix + s), occ.append(o), rec.append(r)
            if len(terms) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names=names)
                terms, occ, rec = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = BurstTrie(burst), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != now:
                    if now is not None:
                        yield from out(trie)
                    trie, now = BurstTrie(burst), row["route"]
                for s, o, r in zip(row["suffixes"], row["occurrences"], row["records"]):
                    trie.add(row["prefix"] + s, o, r)
        if now is not None:
            yield from out(trie)

    return run


def term_frequencies(
    df: DataFrame, key: str = "place_id", order: str = "indexed_at", text: str = "lemmas", bag: str = "bow",
    min_terms: int = 3, rare_below: int = 5, common_above: float = 0.5, burst: int = BURST, flush: int = FLUSH, routes: int = ROUTES,
) -> DataFrame:
    """(term, occurrences, records, mark) over the newest row of every key.

    Null keys are dropped; of rows equal in key and order the larger content counts, so repeated
    rows count once. A record with null, empty or blank text and no usable bag has no terms;
    records of fewer than min_terms occurrences are left out, also of the number of records. mark
    is `rare` for terms in fewer than rare_below records, else `common` for terms in more than
    common_above of the records counted, else null. Other columns are ignored. No rows, no terms.
    """
    blank = F.coalesce(F.regexp_replace(F.col(f"`{text}`"), r"[\s\p{Z}\x{85}\x1c-\x1f]+", "") == "", F.lit(True))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{order}`").alias("at"), F.when(~blank, F.col(f"`{text}`")).alias("text"), F.when(blank, F.col(f"`{bag}`")).alias("bag"))
    newest = latest(rows, ["key"], ["at"], ["text", "bag"]).select("text", "bag")
    parts = materialise(newest.mapInArrow(_count(min_terms, burst, flush), _PART), "terms")
    sizes = parts.select("prefix", F.size("suffixes").alias("n"), "n_records")
    total = sizes.agg(F.sum("n"), F.sum("n_records")).first()
    entries, n_records = total[0] or 0, total[1] or 0
    heavy = heavy_prefixes(sizes.where("n > 0").select("prefix", "n"), entries / routes)
    routed = parts.where(F.size("suffixes") > 0).drop("n_records").mapInArrow(_split(heavy), _ROUTED)
    merged = routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merge(burst), "term string, occurrences long, records long")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n_records, "common")
    return merged.withColumn("mark", mark)
