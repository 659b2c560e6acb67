"""Sources and sinks of regulatory files (SCAN-01 to SCAN-13, SINK-01, SINK-02).

Archives are read as binary files, one a task, and their members become rows; everything after is columns.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MAX_MEMBER = 200 << 20
MAX_ARCHIVE = 100 << 20
MAX_XML = 25 << 20
MAX_DEPTH = 64


def archive_members(archives: DataFrame, member: str = r".*\.csv$", encoding: str = "latin-1") -> DataFrame:
    """SCAN-03: (file, file_sha256, member, text) of archives (file, content): the members whose names match; refuses what is too large."""
    wanted = re.compile(member)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, digest, content in zip(*(batch.column(c) for c in ("file", "digest", "content")), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for info in archive.infolist():
                        if wanted.match(info.filename):
                            if info.file_size > MAX_MEMBER:
                                raise ValueError(f"{info.filename} is over {MAX_MEMBER} bytes")
                            text = archive.read(info).decode(encoding)
                            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name.as_py(), digest.as_py(), info.filename, text)], ["file", "file_sha256", "member", "text"])

    held = F.when(F.octet_length("content") <= MAX_ARCHIVE, F.col("content")).otherwise(F.raise_error(F.lit("archive too large")).cast("binary"))
    return archives.select("file", F.sha2("content", 256).alias("digest"), held.alias("content")).mapInArrow(read, "file string, file_sha256 string, member string, text string")


def zip_members(spark: SparkSession, path: str, member: str = r".*\.csv$", encoding: str = "latin-1") -> DataFrame:
    """SCAN-03: the members of the archives at ``path``; a file that is too large is refused by its length, unread."""
    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") <= MAX_ARCHIVE, F.col("content")).otherwise(F.raise_error(F.lit("archive too large")).cast("binary"))
    return archive_members(files.select(F.col("path").alias("file"), content.alias("content")), member, encoding)


def physical_lines(texts: DataFrame, sep: str = ";") -> DataFrame:
    """SCAN-01: (file, member, line, cells): one record a physical line; a line whose quotes don't close is read with quotes as text.

    Only lines that hold a quote go through Python.
    """

    def cells(line: str) -> list[str]:
        try:
            return next(csv.reader([line], delimiter=sep, strict=True), [])
        except csv.Error:
            return next(csv.reader([line], delimiter=sep, quoting=csv.QUOTE_NONE), [])

    @F.arrow_udf("array<string>")
    def split(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else cells(x) for x in lines.to_pylist()], pa.list_(pa.string()))

    keys = [c for c in texts.columns if c != "text"]
    lines = texts.select(*keys, F.posexplode(F.split("text", "\r?\n")).alias("line", "raw")).where(F.col("raw") != "")
    quoted = split(F.when(F.col("raw").contains('"'), F.col("raw")))
    return lines.select(*keys, "line", F.coalesce(quoted, F.split("raw", re.escape(sep))).alias("cells"))


def with_header(lines: DataFrame, columns: list[str]) -> DataFrame:
    """SCAN-02: records by name; a header or a record of another form is an error."""
    expected = F.array(*[F.lit(c) for c in columns])
    fail = lambda message: F.raise_error(message).cast("boolean")
    record = (
        F.when(F.col("line") == 0, F.when(F.col("cells") == expected, False).otherwise(fail(F.lit("unexpected header"))))
        .when(F.size("cells") != len(columns), fail(F.concat(F.lit("wrong number of fields in line "), F.col("line").cast("string"))))
        .otherwise(True)
    )
    keys = [c for c in lines.columns if c not in ("cells", "line")]
    return lines.where(record).select(*keys, "line", *[F.col("cells")[k].alias(c) for k, c in enumerate(columns)])


def _windows_1252() -> tuple[str, str]:
    """The control characters of ISO-8859-1 and what windows-1252 has in their places."""
    pairs = [(chr(c), bytes([c]).decode("windows-1252", "ignore")) for c in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def typed_csv(spark: SparkSession, path: str, schema: StructType, encoding: str = "windows-1252") -> DataFrame:
    """SCAN-02, SCAN-05: quotes are text; the header's names and order must be the schema's.

    Spark reads ISO-8859-1 but not windows-1252, which differs from it in 27 characters; these are mapped after.
    """
    western = encoding == "windows-1252"
    rows = spark.read.csv(path, schema=schema, header=True, sep=";", encoding="ISO-8859-1" if western else encoding, quote="", mode="FAILFAST", enforceSchema=False)
    if not western:
        return rows
    return rows.select(*[F.translate(f.name, *_windows_1252()).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in schema])


def tab_export(texts: DataFrame, marker: str) -> DataFrame:
    """SCAN-11: (file, line, header, cells) of a tab-separated export after a preamble; the header is the first line with ``marker``."""
    lines = F.split("text", "\r?\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(marker)), F.lit(True))
    header = F.transform(F.split(F.element_at(lines, at.cast("int")), "\t"), lambda x: F.trim(x))
    body = F.filter(F.slice(lines, at.cast("int") + 1, F.size(lines)), lambda x: F.trim(x) != "")
    # once a file, below the generator: beside it the text would be split again for each of its lines
    parts = texts.where(at > 0).select("file", header.alias("header"), body.alias("body"))
    rows = parts.select("file", "header", F.posexplode("body").alias("line", "raw"))
    cells = F.transform(F.split("raw", "\t"), lambda x: F.trim(x))
    padding = F.array_repeat(F.lit(""), F.greatest(F.size("header") - F.size(cells), F.lit(0)))
    return rows.select("file", "line", F.map_from_arrays("header", F.slice(F.concat(cells, padding), 1, F.size("header"))).alias("cells"))


class Leaves:
    """The leaves of XML documents, a list a column; ``chains`` holds all chains, ``ends`` where each of them ends."""

    def __init__(self) -> None:
        self.paths, self.instances, self.chains, self.ends, self.lines, self.texts, self.nils = [], [], [], [0], [], [], []

    def read(self, content: bytes) -> None:
        """Add a document's leaves; refuses size, depth, DOCTYPE and mixed content."""
        if len(content) > MAX_XML:
            raise ValueError("XML too large")
        parser = expat.ParserCreate()
        parser.buffer_text = True
        # of each open element: path, chain, text, whether it is a leaf, line, nil, how many children of each tag
        stack = []

        def start(tag, attributes):
            if len(stack) >= MAX_DEPTH:
                raise ValueError("XML too deep")
            nil = bool(attributes) and any(k.rpartition(":")[2] == "nil" and v in ("true", "1") for k, v in attributes.items())
            if not stack:
                stack.append([tag, (0,), "", True, parser.CurrentLineNumber, nil, {}])
                return
            parent = stack[-1]
            if parent[2] and parent[2].strip():
                raise ValueError("mixed content")
            parent[3] = False
            met = parent[6]
            at = met[tag] = met.get(tag, -1) + 1
            stack.append([f"{parent[0]}/{tag}", (*parent[1], at), "", True, parser.CurrentLineNumber, nil, {}])

        def text(data):
            node = stack[-1]
            node[2] += data
            if not node[3] and data.strip():
                raise ValueError("mixed content")

        def end(_):
            path, chain, held, leaf, line, nil, _met = stack.pop()
            if leaf:
                self.paths.append(path)
                self.instances.append(chain[-1])
                self.chains.extend(chain[:-1])
                self.ends.append(len(self.chains))
                self.lines.append(line)
                self.texts.append(held)
                self.nils.append(nil)

        def doctype(*_):
            raise ValueError("DOCTYPE is refused")

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, text, doctype
        parser.Parse(content, True)


def xml_leaves(content: bytes) -> list[tuple[str, int, list[int], int, str, bool]]:
    """SCAN-13: (path, instance, chain, line, text, nil) of each leaf; refuses size, depth, DOCTYPE and mixed content."""
    found = Leaves()
    found.read(content)
    chains = [found.chains[a:b] for a, b in itertools.pairwise(found.ends)]
    return list(zip(found.paths, found.instances, chains, found.lines, found.texts, found.nils, strict=True))


def xml_values(documents: DataFrame, content: str = "content") -> DataFrame:
    """SCAN-13: a row for each leaf of each document, the other columns kept."""

    @F.arrow_udf("array<struct<xml_path: string, instance_index: int, chain: array<int>, line: int, raw_text: string, xsi_nil: boolean>>")
    def walk(contents: pa.Array) -> pa.Array:
        found, ends = Leaves(), [0]
        for one in contents.to_pylist():
            found.read(one)
            ends.append(len(found.paths))
        whole = lambda x: pa.array(x, pa.int32())
        columns = [pa.array(found.paths, pa.string()), whole(found.instances), pa.ListArray.from_arrays(whole(found.ends), whole(found.chains)), whole(found.lines), pa.array(found.texts, pa.string()), pa.array(found.nils, pa.bool_())]
        return pa.ListArray.from_arrays(whole(ends), pa.StructArray.from_arrays(columns, ["xml_path", "instance_index", "chain", "line", "raw_text", "xsi_nil"]))

    keys = [c for c in documents.columns if c != content]
    return documents.select(*keys, F.inline(walk(F.col(content))))


def land_as_text(frames: list[DataFrame]) -> DataFrame:
    """Additive drift: columns of all files, as text, missing ones null."""
    found = None
    for df in frames:
        text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        found = text if found is None else found.unionByName(text, allowMissingColumns=True)
    return found


def newest_files(manifest: DataFrame) -> DataFrame:
    """SCAN-03: the last file of each (kind, year) is current; content seen before is no new file."""
    first = manifest.groupBy("kind", "year", "sha256").agg(F.min("file_id").alias("file_id"))
    return first.groupBy("kind", "year").agg(F.max("file_id").alias("file_id"))


def export(df: DataFrame, path: str, kind: str = "csv", sep: str = ",") -> None:
    """SINK-01, SINK-02: CSV with a byte-order mark and a header in each file, or JSON lines with nulls written."""
    if kind == "csv":
        first, *rest = df.columns
        marked = df.select(F.col(first).alias("\ufeff" + first), *rest)
        marked.write.mode("overwrite").csv(path, header=True, encoding="UTF-8", sep=sep)
    elif kind == "json":
        df.write.mode("overwrite").json(path, ignoreNullFields=False)
    else:
        raise ValueError(f"unknown format {kind}")


def consolidated(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SINK-01: of a history, the newest row of each key, for the export beside the whole history."""
    rest = [c for c in history.columns if c not in keys]
    newest = history.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return newest.select(*keys, "r.*").select(*history.columns)
