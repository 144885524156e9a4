"""An inverted index of texts that grows by segments.

A segment holds a row for each term and document, with the places of the term in it, sorted by term and range-partitioned. Parquet
keeps terms by what they add to the term before, and documents by their differences. A table beside the segment has the first
and last term of each file, so a search opens only the files whose range holds what it looks for. New documents become a new
segment, and segments of a size are merged into one of the next; a manifest, written last, says which belong to the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.plans.stage import dropped
from pactum.sources.manifest import Manifest

#: A word is a run of these.
WORD = r"[\p{L}\p{N}_]+"
#: Text that one file of postings is made of, and segments of a level that are merged.
FILE_BYTES, FANOUT = 32 << 20, 4
LAST_CHARACTER = "\U0010ffff"

POSTINGS = "term string, doc_id long, places array<int>"
_DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#term": "false", "compression": "zstd"}


def terms_of(text: Column) -> Column:
    """The words of a text in their order, without case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _gathered(doc: np.ndarray, place: np.ndarray, term: pa.Array) -> pa.RecordBatch:
    """A row for each term and document, with the sorted places, of words that each have all three."""
    coded = term.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.lexsort((place, code, doc))
    doc, code = doc[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]))
    ends = np.append(first, len(doc)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order]))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(doc[first]), places], ["term", "doc_id", "places"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gathers the words (doc_id, place, term) of whole texts, whose rows follow each other; a text may go on in the next batch."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = np.flatnonzero(b.column(1).to_numpy() == 0)
        if not starts.size:
            kept.append(b)
            continue
        at = int(starts[-1])  # where the last text begins, which may go on
        yield from _whole([*kept, b.slice(0, at)])
        kept = [b.slice(at)]
    yield from _whole(kept)


def _whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts and (t := pa.Table.from_batches(parts).combine_chunks()).num_rows:
        doc, place, term = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in t.columns)
        yield _gathered(doc.to_numpy(), place.to_numpy(), term)


class TextIndex:
    """An index below a folder, at the version that was the latest when it was opened or last changed by this object.

    Documents are told apart by doc_id, a long. A document that is added again takes the place of the earlier one; rows of one
    doc_id within one call are one document, one text after the other. Rows without doc_id or text are not indexed.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, file_bytes: int = FILE_BYTES):
        self.spark, self.folder, self.fanout, self.file_bytes = spark, folder.rstrip("/"), fanout, file_bytes
        self.manifest = Manifest(spark, folder)
        self.version = self.manifest.latest()
        self.state = self.manifest.read(self.version) or {"segments": [], "sources": []}

    # --- writing

    def _commit(self, segments: list[dict], sources: list[str]) -> None:
        state = {"segments": segments, "sources": sources}
        self.version = self.manifest.commit(self.version, state)
        self.state = state

    def _segment(self, postings: DataFrame, documents: DataFrame, size: int, level: int, repeated: bool) -> dict:
        """Writes postings and the ids of their documents; names the segment. repeated: a term and document may have several rows."""
        path = f"{self.folder}/segment-{uuid.uuid4().hex}"
        files = max(1, -(-size // self.file_bytes))
        # a frequent term's documents spread over several files, as ranges are of terms and documents
        ranged = postings.repartitionByRange(files, "term", "doc_id")
        if repeated:
            ranged = ranged.groupBy("term", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        ranged.sortWithinPartitions("term", "doc_id").write.options(**_DELTAS).parquet(f"{path}/postings")
        documents.select("doc_id").distinct().sortWithinPartitions("doc_id").write.options(**_DELTAS).parquet(f"{path}/documents")
        held = self.spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        held.groupBy(F.input_file_name().alias("file")).agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/files")
        return {"path": path, "level": level, "bytes": size}

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Makes a segment of docs; earlier ones are not read, unless there are enough of them to merge."""
        self._add(docs, id_col, text_col, [])

    def refresh(self, paths: list[str], id_col: str = "doc_id", text_col: str = "text") -> list[str]:
        """Adds the Parquet files (or folders) that the index hasn't read yet; returns those."""
        known = set(self.state["sources"])
        new = [p for p in dict.fromkeys(paths) if p not in known]
        if new:
            self._add(self.spark.read.parquet(*new), id_col, text_col, new)
        return new

    def _add(self, docs: DataFrame, id_col: str, text_col: str, sources: list[str]) -> None:
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).dropna()
        size, repeated = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).agg(F.sum("b"), F.max("n") > 1).first()
        segments = list(self.state["segments"])
        if size is not None:
            words = rows.select("doc_id", F.posexplode(terms_of(F.col("text"))).alias("place", "term"))
            # a text's words are gathered where it is read, so a row for each of its terms is sorted and moved, and not one for each word
            segments.append(self._segment(words.mapInArrow(_by_document, POSTINGS), rows, size, 0, repeated))
        self._commit(segments, [*self.state["sources"], *sources])
        while (level := self._full()) is not None:
            self.merge(level)

    def _full(self) -> int | None:
        levels = [s["level"] for s in self.state["segments"]]
        return next((x for x in sorted(set(levels)) if levels.count(x) >= self.fanout), None)

    def merge(self, level: int) -> None:
        """Makes one segment of those of a level; replaced documents are left out, and texts aren't read again."""
        old = [s for s in self.state["segments"] if s["level"] == level]
        parts = [(self._current(s, self._postings(s)), self._current(s, self._documents(s))) for s in old]
        postings, documents = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
        new = self._segment(postings, documents, sum(s["bytes"] for s in old), level + 1, False)  # a document is current in one segment
        first = self.state["segments"].index(old[0])
        rest = [s for s in self.state["segments"] if s not in old]
        # a level's segments follow each other in age, so the merged one takes the place of the first
        self._commit([*rest[:first], new, *rest[first:]], self.state["sources"])

    def vacuum(self) -> None:
        """Removes the folders of segments that the index doesn't have any more; readers of older versions lose theirs."""
        held = {s["path"] for s in self.state["segments"]}
        for version in range(1, self.version):
            for s in self.manifest.read(version).get("segments", []):
                if s["path"] not in held:
                    dropped(self.spark, s["path"])

    # --- reading

    def _postings(self, segment: dict, files: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(*(files or [f"{segment['path']}/postings"]))

    def _documents(self, segment: dict) -> DataFrame:
        return self.spark.read.schema("doc_id long").parquet(f"{segment['path']}/documents")

    def _current(self, segment: dict, rows: DataFrame) -> DataFrame:
        """rows of a segment without documents that a later one has."""
        at = self.state["segments"].index(segment)
        later = [self._documents(s) for s in self.state["segments"][at + 1 :]]
        return rows.join(reduce(DataFrame.unionByName, later), "doc_id", "left_anti") if later else rows

    def files(self, low: str, high: str) -> list[tuple[dict, list[str]]]:
        """For each segment, the files that may hold terms from low to high."""
        out = []
        for s in self.state["segments"]:
            found = self.spark.read.parquet(f"{s['path']}/files").filter((F.col("last") >= low) & (F.col("first") <= high))
            if names := sorted(r.file for r in found.select("file").collect()):
                out.append((s, names))
        return out

    def postings(self, word: str, prefix: bool = False) -> DataFrame:
        """term, doc_id, places of a word, or of all words that begin with it."""
        word = word.lower()
        held = F.startswith("term", F.lit(word)) if prefix else F.col("term") == word
        found = [self._current(s, self._postings(s, names).filter(held)) for s, names in self.files(word, word + LAST_CHARACTER if prefix else word)]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], POSTINGS)

    def prefix(self, prefix: str) -> DataFrame:
        """doc_id of the documents with a word that begins with prefix."""
        return self.postings(prefix, True).select("doc_id").distinct()

    def every(self, words: list[str]) -> DataFrame:
        """doc_id of the documents that have each of the words."""
        return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [self.postings(w).select("doc_id") for w in dict.fromkeys(x.lower() for x in words)])

    def phrase(self, text: str, prefix: bool = False) -> DataFrame:
        """doc_id, n (places) of the documents in which the text's words follow each other; prefix: the last word may go on."""
        words = [r.w for r in self.spark.range(1).select(F.explode(terms_of(F.lit(text))).alias("w")).collect()]
        if not words:
            return self.spark.createDataFrame([], "doc_id long, n long")
        at = lambda i: self.postings(words[i], prefix and i == len(words) - 1).select("doc_id", F.explode("places").alias("at")).select("doc_id", (F.col("at") - i).alias("at"))
        # places meet by document and place, so a frequent word's are dealt to all tasks
        return reduce(lambda a, b: a.join(b, ["doc_id", "at"], "left_semi"), map(at, range(len(words)))).groupBy("doc_id").agg(F.count("*").alias("n"))

    def frequencies(self, prefix: str = "") -> DataFrame:
        """term, n_docs, n: the dictionary."""
        return self.postings(prefix, True).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("places")).alias("n"))
