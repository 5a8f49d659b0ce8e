"""Sources: the given tables, document files, and text runs laid out from documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = "CASE WHEN word LIKE '%.' THEN 30.0 WHEN word LIKE '%,' THEN 12.0 ELSE 2.0 END"
LINES_PER_PAGE = 50
#: Bytes of texts that are laid out at a time, longer ones alone.
PART = 1 << 20
#: A text run as a struct.
RUN = "struct<ln:int,wn:int,text:string,x:double,y:double,width:double,size:double,space_w:double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """One row per file: path, length, content, and whether its first 1,024 bytes hold the signature of the format."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("has_header", F.expr("instr(decode(substring(content, 1, 1024), 'ISO-8859-1'), '%PDF-') > 0"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, line) of each text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where a scan has few splits (a small file is often one row group), as work on whole texts
    costs more than the exchange. A table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each page of some texts its text, its number and its runs: 5 points a character, and a gap after each word."""
    lines = pc.split_pattern(texts, "\n")
    document, n_lines = pc.list_parent_indices(lines).to_numpy(), pc.list_value_length(lines).to_numpy()
    ln = np.arange(len(document)) - (np.cumsum(n_lines) - n_lines)[document]
    words = pc.split_pattern(lines.flatten(), " ")
    line, n_words = pc.list_parent_indices(words).to_numpy(), pc.list_value_length(words).to_numpy()
    wn, text = np.arange(len(line)) - (np.cumsum(n_words) - n_words)[line], words.flatten()
    some = pc.not_equal(text, "")
    text, kept = text.filter(some), some.to_numpy(zero_copy_only=False)
    line, wn, size = line[kept], wn[kept], pc.utf8_length(text).to_numpy()
    width = 5.0 * size
    step = width + np.where(pc.ends_with(text, "."), 30.0, np.where(pc.ends_with(text, ","), 12.0, 2.0))
    before = np.cumsum(step) - step  # whole numbers, so differences of sums are exact
    x = before - before[np.searchsorted(line, line)]
    y = 14.0 * ln[line] + np.where(size % 3 == 0, 0.4, np.where(size % 7 == 0, 0.5, 0.0))
    n_pages = (n_lines - 1) // LINES_PER_PAGE + 1
    first = np.cumsum(n_pages) - n_pages
    owner = np.repeat(np.arange(len(n_pages)), n_pages)
    counts = np.bincount(first[document[line]] + ln[line] // LINES_PER_PAGE, minlength=len(owner))
    columns = {"ln": ln[line].astype(np.int32), "wn": wn.astype(np.int32), "text": text.cast(pa.string()), "x": x, "y": y, "width": width, "size": np.full(len(x), 10.0), "space_w": np.full(len(x), 5.0)}
    runs = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    return owner, np.arange(len(owner)) - first[owner], pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), runs)


#: Of the runs of some pages, an array of RUN for each: the page (its place among them) of every row that is made of them, and the rows' columns.
#: With columns beside the text it also gets each page's text (its place among them), each page's number, and those columns of the texts.
Each = Callable[..., tuple[np.ndarray, list[pa.Array]]]


def _parts(each: Each, names: list[str], beside: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column("text"), 0
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            while lo < len(texts):
                hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, side="right")), lo + 1)
                owner, page, runs = _laid_out(texts.slice(lo, hi - lo))
                at, columns = each(runs, owner, page, *(batch.column(c).slice(lo, hi - lo) for c in beside)) if beside else each(runs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner[at] + lo)), pa.array(page[at].astype(np.int32)), *columns], ["doc_id", "page", *names])
                lo = hi

    return of


def page_rows(docs: DataFrame, each: Each, columns: str, *beside: str) -> DataFrame:
    """(doc_id, page, ``columns`` as in a schema): the rows that ``each`` makes of pages' runs. Runs are ten to twenty times as large as their
    text, so they are made and used in one step of a task, those of PART bytes of text at a time, and never leave it. Texts with columns
    ``beside`` them come from a join, which has dealt them."""
    names = [c.split(" ", 1)[0] for c in columns.split(", ")]
    document = docs.schema["doc_id"].dataType.simpleString()
    docs = docs if beside else spread(docs)
    return docs.filter("text is not null").select("doc_id", "text", *beside).mapInArrow(_parts(each, names, beside), f"doc_id {document}, page int, {columns}")


def page_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, page, runs): words of each page's lines as text runs of size 10, 14 points a line. No shuffle: a page is put
    together from its text's row, some texts at a time. Baselines of some words are 0.4 or 0.5 lower."""
    return page_rows(docs, lambda runs: (np.arange(len(runs)), [runs]), f"runs array<{RUN}>")


def runs(docs: DataFrame) -> DataFrame:
    """The runs of ``page_runs``, a row each."""
    return page_runs(docs).select("doc_id", "page", F.inline("runs"))


#: The same runs for the oracle.
RUNS_SQL = f"""lines AS (
  SELECT doc_id, u.ln - 1 AS ln, ls[u.ln] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(ln)
), words AS (
  SELECT doc_id, ln, u.wn - 1 AS wn, ws[u.wn] AS word FROM (SELECT doc_id, ln, string_split(line, ' ') AS ws FROM lines), unnest(range(1, len(ws) + 1)) AS u(wn)
  WHERE ws[u.wn] <> ''
), runs AS (
  SELECT doc_id, CAST(ln // 50 AS INT) AS page, CAST(ln AS INT) AS ln, CAST(wn AS INT) AS wn, word AS text, 5.0::DOUBLE * length(word) AS width,
         coalesce(sum(5.0::DOUBLE * length(word) + {GAP}) OVER (PARTITION BY doc_id, ln ORDER BY wn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS x,
         14.0::DOUBLE * ln + CASE WHEN length(word) % 3 = 0 THEN 0.4::DOUBLE WHEN length(word) % 7 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS y
  FROM words
)"""
