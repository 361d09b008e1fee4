"""FTS-1/2 over a stored index: segments, deletions, merges, searches.

    postings/segment=3/bucket=17/   (token, doc_id, tf) of the documents added by step 3
    deleted/segment=4/              ids whose postings in earlier segments are void
    manifest/version=5/             numbers of the segments that count

Each step writes folders of its own number and then a new manifest, so a step that
failed may be run again and is invisible until it is complete. A search reads the
folders of the live segments and of its terms' buckets, never a text. Merging writes
the live postings of several segments as one and drops void ones; folders that no
manifest names any more go with ``vacuum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentscope.operators.search import match_all_terms, query_terms, token_index
from talentscope.session import drop_folder, folder_names

POSTINGS = "token string, doc_id {id}, tf long, segment int, bucket int"
DELETED = "doc_id {id}, segment int"


class TextIndex:
    """An index at ``path``. ``buckets`` and the type of document ids belong to its
    definition; a bucket's postings of one step are dealt to ``files`` writers by
    document, so that a frequent token is no single file."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "long",
                 files: int = 1):
        self.spark, self.path, self.buckets, self.files = spark, path, buckets, files
        self._postings, self._deleted = POSTINGS.format(id=id_type), DELETED.format(id=id_type)

    # -- steps ----------------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in folder_names(self.spark, f"{self.path}/manifest"))

    def segments(self) -> list[int]:
        """Numbers of the segments that count."""
        versions = self.versions()
        if not versions:
            return []
        row = self.spark.read.schema("segments array<int>").parquet(
            f"{self.path}/manifest/version={versions[-1]}").first()
        return list(row["segments"])

    def _publish(self, segments: list[int], version: int) -> None:
        self.spark.createDataFrame([(segments,)], "segments array<int>").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _next(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def _write_postings(self, postings: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(self.files))
        (postings.withColumn("bucket", self._bucket("token"))
         .repartition(self.buckets * self.files, "bucket", part)
         .write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{self.path}/postings/segment={number}"))

    def _bucket(self, token: str):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def change(self, added: DataFrame | None = None, deleted: DataFrame | None = None,
               doc_id: str = "id", text: str = "content") -> int:
        """One step: the ids in ``deleted`` go, then the documents in ``added`` come; a
        changed document is in both. Returns the step's number."""
        number = self._next()
        if added is not None:
            self._write_postings(token_index(added, doc_id, text), number)
        if deleted is not None:
            deleted.select(F.col(doc_id).alias("doc_id")).distinct().write.mode("overwrite").parquet(
                f"{self.path}/deleted/segment={number}")
        self._publish([*self.segments(), number], number)
        return number

    def merge(self) -> int:
        """All segments as one, without void postings."""
        number = self._next()
        self._write_postings(self.postings().select("token", "doc_id", "tf"), number)
        self._publish([number], number)
        return number

    def vacuum(self) -> None:
        """Removes segments that do not count and earlier manifests."""
        live = set(self.segments())
        for kind in ("postings", "deleted"):
            for name in folder_names(self.spark, f"{self.path}/{kind}"):
                if int(name.split("=")[1]) not in live:
                    drop_folder(self.spark, f"{self.path}/{kind}/{name}")
        for version in self.versions()[:-1]:
            drop_folder(self.spark, f"{self.path}/manifest/version={version}")

    # -- reads ----------------------------------------------------------------
    def _stored(self, kind: str, schema: str, segments: list[int]) -> DataFrame:
        if not folder_names(self.spark, f"{self.path}/{kind}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return rows.filter(F.col("segment").isin(segments))

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(token, doc_id, tf) of the documents that are in the index now."""
        segments = self.segments()
        rows = self._stored("postings", self._postings, segments)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        # the last step that deleted an id voids its postings of earlier steps
        gone = (self._stored("deleted", self._deleted, segments)
                .groupBy("doc_id").agg(F.max("segment").alias("until")))
        return (rows.join(gone, "doc_id", "left")
                .filter(F.col("until").isNull() | (F.col("segment") >= F.col("until")))
                .select("token", "doc_id", "tf"))

    def search(self, queries: DataFrame) -> DataFrame:
        """FTS-2: (query_id, doc_id) of the documents that hold all terms of a query;
        a query without terms finds nothing."""
        terms = query_terms(queries)
        needed = [r[0] for r in terms.select(self._bucket("token")).distinct().collect()]
        return match_all_terms(terms, self.postings(sorted(needed)).select("token", "doc_id"), "doc_id")
