"""Publications after a load counter as a streaming source: the counter is the stream's offset.

The store holds publications in folders by range of the counter (span), so the rows after a counter are found by name; a
micro-batch is planned as one task for each piece of a span, and each row is read once. No list of files is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from attest import schemas

SPAN = 100_000  # counters in a folder


def write_spans(pubs: DataFrame, path: str, span: int = SPAN) -> None:
    """Add publications to the store: any files, in the folders of their counters."""
    pubs.withColumn("span", F.expr(f"counter div {span}")).write.mode("append").partitionBy("span").parquet(path)


class _Piece(InputPartition):
    def __init__(self, span: int, after: int, upto: int) -> None:
        self.span, self.after, self.upto = span, after, upto


def planned(after: int, upto: int, span: int, rows: int) -> list[tuple[int, int, int]]:
    """(span, after, upto): the counters after one up to another, cut at spans and into pieces of so many."""
    out = []
    while after < upto:
        in_span = (after + 1) // span
        end = min(upto, (in_span + 1) * span - 1, after + rows)
        out.append((in_span, after, end))
        after = end
    return out


class CounterReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict) -> None:
        self.path, self.span = options["path"], int(options.get("span", SPAN))
        self.rows, self.after = int(options.get("rowsPerTask", 20_000)), int(options.get("after", -1))
        self.form = to_arrow_schema(schema)

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {"counter": self.after}

    def latestOffset(self) -> dict:
        """The largest counter that is there, from the last span's file statistics."""
        store, at = self._store()
        spans = sorted((int(i.base_name.split("=")[1]) for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.base_name.startswith("span=")), reverse=True)
        top = self.after
        for s in spans[:1]:
            for piece in ds.dataset(f"{at}/span={s}", filesystem=store, format="parquet").get_fragments():
                column = piece.metadata.schema.names.index("counter")
                for g in range(piece.metadata.num_row_groups):
                    top = max(top, piece.metadata.row_group(g).column(column).statistics.max)
        return {"counter": top}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Piece(*p) for p in planned(start["counter"], end["counter"], self.span, self.rows)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        store, at = self._store()
        folder = f"{at}/span={partition.span}"
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return  # a span without publications
        wanted = (pc.field("counter") > partition.after) & (pc.field("counter") <= partition.upto)
        found = ds.dataset(folder, filesystem=store, format="parquet").to_table(columns=self.form.names, filter=wanted).sort_by("counter")
        yield from found.cast(self.form).to_batches()

    def commit(self, end: dict) -> None:
        return None


class CounterSource(DataSource):
    """format("publications_by_counter"): options path, after (the counter to start behind), span, rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "publications_by_counter"

    def schema(self) -> str:
        return schemas.PUBLICATIONS

    def streamReader(self, schema) -> CounterReader:
        return CounterReader(schema, self.options)


def stream_by_counter(spark: SparkSession, path: str, after: int = -1, **options) -> DataFrame:
    """Publications with a counter above ``after`` as they come into the store; a checkpoint goes on from the counter it has reached.

    Later publications with lower counters are not seen, as with any peer that is asked for what comes after a counter.
    """
    spark.dataSource.register(CounterSource)
    reader = spark.readStream.format("publications_by_counter").option("path", path).option("after", str(after))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
