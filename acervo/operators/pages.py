"""Files and their pages: results per file, typed elements, reading order, running lines, corrected text."""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.functions import objective as O
from acervo.functions.objective import page_similarity
from acervo.operators.encoders import complete
from acervo.operators.ranking import bucket_rank
from acervo.runtime import materialise

#: Weights of the first lines of a page as headers.
HEADER = (1.0, 0.75, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)
#: Characters of a piece of a file's text.
PIECE = 1 << 18


def text_of(content: bytes) -> str | None:
    """The default parser of files: UTF-8 text, null for anything else."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return None


def map_files(files: DataFrame, parse: Callable[[bytes], str | None] = text_of) -> DataFrame:
    """(path, result) of a parser (of PDFs, of images with a model that describes them) over files(path, content);
    a file it fails on has a null result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append(parse(content))
                except Exception:  # noqa: BLE001 - a damaged file is a result
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "result"])

    return files.select("path", "content").mapInArrow(run, "path string, result string")


def file_pieces(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, at, before, piece): the text of UTF-8 files(path) in pieces of some `piece` characters, read as a stream, so
    that no task holds a file. White space at its ends is left out; a piece ends before white space, and is
    longer only where a word is; before is the end of the piece ahead. A text without pieces has an empty one,
    a file that can't be read or decoded ends with a null one."""
    blank, tail = " \t\n\x0b\f\r", max(map(len, O.NOT_THE_DOCUMENT))

    def cuts(path: str) -> Iterator[str]:
        where, name = fs.FileSystem.from_uri(path)
        decode, held, begun = codecs.getincrementaldecoder("utf-8")().decode, "", False
        with where.open_input_stream(name) as stream:
            while True:
                chunk = stream.read(piece)
                held += decode(chunk, final=not chunk)
                if not begun:
                    held = held.lstrip(blank)
                    begun = bool(held)
                if not chunk:
                    yield held.rstrip(blank)
                    return
                end = len(held.rstrip(blank))  # white space that may be the last stays
                at = max(held.rfind(b, 1, end) for b in blank)
                if len(held) >= piece and at > 0:
                    yield held[:at]
                    held = held[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*cells) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "at", "before", "piece"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                at, before = 0, ""
                try:
                    for text in cuts(path):
                        yield row(path, at, before, text)
                        at, before = at + 1, (before + text)[-tail:]
                except (OSError, UnicodeDecodeError):  # a damaged file is a result
                    yield row(path, at, before, None)

    return files.select("path").mapInArrow(run, "path string, at long, before string, piece string")


def extracted_lengths(pieces: DataFrame) -> DataFrame:
    """(path, n): the length of objective.extracted of a text in pieces(path, before, piece) as file_pieces gives them."""
    plain = F.length(O.plain(F.col("piece")))
    other = reduce(Column.__or__, [F.concat("before", "piece").contains(part) for part in O.NOT_THE_DOCUMENT])
    rows = pieces.select("path", F.col("piece").isNull().alias("bad"), other.alias("other"), F.length("piece").alias("size"), O.letters(F.col("piece")).alias("good"), plain.alias("plain"))
    sums = rows.groupBy("path").agg(F.max("bad").alias("bad"), F.max("other").alias("other"), F.sum("size").alias("size"), F.sum("good").alias("good"), F.sum("plain").alias("plain"), F.count_if(F.col("plain") > 0).alias("n"))
    legible = (F.col("size") >= 20) & (F.col("good") / F.greatest("size", F.lit(1)) >= 0.5)
    joined = F.col("plain") + F.greatest(F.col("n") - 1, F.lit(0))  # a space between two pieces
    return sums.select("path", F.when(F.col("bad"), len(O.UNOPENED)).when(F.col("other"), len(O.FILTERED)).when(~legible, len(O.ILLEGIBLE)).otherwise(joined).cast("long").alias("n"))


def numbered(files: DataFrame) -> DataFrame:
    """files with pdf_id, their place from 0 by the last folder and the name, then by the whole path."""
    held = materialise(files.withColumn("_b", F.substring_index("path", "/", -2)), "files")
    return bucket_rank(held, [], "_b", [F.asc("path")], "_r").withColumn("pdf_id", F.col("_r") - 1).drop("_b", "_r")


def elements(pages: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """(key, page, element_id, element_type, content): the runs of table lines (with bars, tabs or two semicolons)
    and of other lines of each page, in order, ids from 0 within the page. Blank lines belong to none."""
    lines = pages.select(key, page, F.posexplode(F.split(text, "\n")).alias("_i", "_l")).where(F.trim("_l") != "")
    kind = F.when(F.col("_l").rlike(r"\||\t|;.*;"), "table").otherwise("text")
    w = Window.partitionBy(key, page).orderBy("_i")  # the lines of a page
    runs = lines.withColumn("element_type", kind).withColumn("_new", (F.col("element_type") != F.lag("element_type", 1, "").over(w)).cast("int"))
    held = runs.withColumn("element_id", F.sum("_new").over(w) - 1).groupBy(key, page, "element_id", "element_type").agg(F.array_sort(F.collect_list(F.struct("_i", "_l"))).alias("_e"))
    return held.select(key, page, "element_id", "element_type", F.array_join(F.transform("_e", lambda e: e["_l"]), "\n").alias("content"))


def flattened(parts: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, raw_text): the contents of a document's elements joined by spaces in order."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, "element_id", "content"))).alias("_e"))
    return rows.select(key, F.array_join(F.transform("_e", lambda e: e["content"]), " ").alias("raw_text"))


def reading_order(boxes: DataFrame, page: list[str]) -> DataFrame:
    """boxes(page, x0, y0, x1, y1) with their column (a new one begins right of all that begin before it) and their
    place from 1, by column, then from the top, then from the left. Boxes without a left edge are left out."""
    w = Window.partitionBy(*page).orderBy("x0")  # the left edges of a page
    edges = boxes.groupBy(*page, "x0").agg(F.max("x1").alias("_x1"))
    new = F.coalesce(F.col("x0") >= F.max("_x1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    columns = edges.withColumn("_new", new).withColumn("column", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_x1")
    rows = boxes.join(columns, [*page, "x0"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("column", "y0", "x0", "x1", "y1")))


def inside(points: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Points(page, x, y) that lie in a box(page, x0, y0, x1, y1) of their page; once, however many hold them."""
    same = F.col(f"p.{page}") == F.col(f"b.{page}")
    held = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return points.alias("p").join(boxes.alias("b"), same & held, "left_semi")


def running_lines(pages: DataFrame, key: str, page: str = "page", text: str = "text", weights: tuple[float, ...] = HEADER, window: int = 8, last: bool = False) -> DataFrame:
    """(key, line): the lines that run as headers: among the first of a page, trimmed and not blank, those like the
    ones at the same place of the pages around, their mean similarity times the weight of the place above a
    half. With `last` as footers: among the last of a page, places counted from its end, unweighed. The first page of a document is compared but with documents of one page compares with none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select(key, page, F.posexplode(F.slice(F.reverse(lines) if last else lines, 1, len(weights))).alias("at", "line"))
    sizes = pages.groupBy(key).agg((F.max(page) + 1).alias("n"))
    first = rows.join(sizes, key).withColumn("low", F.greatest(F.col(page) - window, F.lit(1))).withColumn("high", F.least(F.col(page) + window, F.col("n")) - 1)
    alone = F.col("low") > F.col("high")
    first = first.withColumn("low", F.when(alone, 0).otherwise(F.col("low"))).withColumn("high", F.when(alone, F.col("n") - 1).otherwise(F.col("high")))
    near = first.select(key, page, "at", "line", (F.col("high") - F.col("low") + 1).alias("m"), F.explode(F.sequence("low", "high")).alias("other"))
    met = near.join(rows.select(key, F.col(page).alias("other"), "at", F.col("line").alias("there")), [key, "other", "at"])
    weight = F.array(*[F.lit(1.0 if last else w) for w in weights])[F.col("at")]
    score = F.sum(page_similarity(F.col("line"), F.col("there"))) / F.max("m") * F.max(weight)
    return met.groupBy(key, page, "at", "line").agg(score.alias("score")).where("score > 0.5").select(key, "line").distinct()


def corrected(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[str]], words: int = 1000, cache: str | None = None, out: str = "corrected") -> DataFrame:
    """df with its text passed through a model in pieces of `words` words, joined by spaces."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pieces = df.select(key, tokens.alias("_w")).where(F.size("_w") > 0).select(key, "_w", F.explode(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / words).cast("int"))).alias("_at"))
    done = complete(pieces.select(key, "_at", F.array_join(F.slice("_w", F.col("_at") * words + 1, words), " ").alias("_piece")), "_piece", model, cache, "correct", out="_done")
    joined = done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_done"))), lambda e: e["_done"]), " ").alias(out))
    return df.join(joined, key, "left")
