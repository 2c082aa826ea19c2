"""Driver utilities around files: resumable downloads, verified copies, byte ranges, captured map-data responses."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tarn.streaming.trips import retried

ELEMENTS = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a session on one machine without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see by one path, for formats that are read by path."""
    base = checkpoint_folder(spark)
    if "://" in base and not base.startswith("file://"):
        raise RuntimeError("the shared folder must be mounted to be used by path")
    path = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


class PayloadError(ValueError):
    """A file is not what it should be."""


def payload_kind(head: bytes) -> str | None:
    """pbf, tiff, pmtiles or html by the first bytes."""
    if head[:7] == b"PMTiles":
        return "pmtiles"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if len(head) >= 16 and 0 < int.from_bytes(head[:4], "big") <= 64 << 10 and b"OSMHeader" in head[4:32]:
        return "pbf"
    if head.lstrip().lower().startswith((b"<!doctype", b"<html")):
        return "html"
    return None


def validate(path: str, kind: str) -> None:
    with open(path, "rb") as f:
        found = payload_kind(f.read(64))
    if found != kind:
        raise PayloadError(f"{path} is {found or 'unknown'}, not {kind}")


def plan_resume(local: int, remote: int | None) -> tuple[str, str | None]:
    """(fresh, complete or resume, the range that is asked for)."""
    if local <= 0 or (remote is not None and local > remote):
        return "fresh", None
    if remote is not None and local == remote:
        return "complete", None
    return "resume", f"bytes={local}-"


def download(url: str, path: str, kind: str, open_url: Callable = urllib.request.urlopen) -> int:
    """Fetches a file, going on from a part that is there; what arrives is checked before it gets its name."""
    part = f"{path}.part"
    have = os.path.getsize(part) if os.path.exists(part) else 0
    _, asked = plan_resume(have, None)
    request = urllib.request.Request(url, headers={"Range": asked} if asked else {})
    try:
        with open_url(request) as response:
            # A server that does not know ranges sends the whole file: 200 starts afresh, 206 goes on.
            with open(part, "ab" if asked and response.status == 206 else "wb") as out:
                shutil.copyfileobj(response, out, 1 << 20)
    except urllib.error.HTTPError as e:
        if e.code != 416:  # nothing is left to send
            raise
    validate(part, kind)
    os.replace(part, path)
    return os.path.getsize(path)


def read_range(path: str, offset: int, length: int) -> bytes:
    """Bytes of a file, fewer at its end, none beyond it."""
    with open(path, "rb") as f:
        f.seek(offset)
        return f.read(max(0, length))


def copy_verified(source: str, target: str, block: int = 8 << 20) -> int:
    """Copies a file by blocks; unless as many bytes arrive as there are, nothing stays under the target's name."""
    size, done = os.path.getsize(source), 0
    part = f"{target}.part"
    with open(source, "rb") as a, open(part, "wb") as b:
        while raw := a.read(block):
            b.write(raw)
            done += len(raw)
        b.flush()
        os.fsync(b.fileno())
    if done != size or os.path.getsize(part) != size:
        os.remove(part)
        raise PayloadError(f"copied {done} of {size} bytes")
    os.replace(part, target)
    return done


class Registry:
    """Open archives by name; a key matches its name or a path below it, a miss is an error.  Counts what is read."""

    def __init__(self):
        self.files: dict[str, str] = {}
        self.reads, self.total_bytes, self.last = 0, 0, None

    def bind(self, name: str, path: str) -> None:
        validate(path, "pmtiles")
        self.files[name] = path

    def match(self, key: str) -> str:
        for name, path in sorted(self.files.items(), key=lambda x: -len(x[0])):
            if key == name or key.startswith(name + "/"):
                return path
        raise KeyError(key)

    def read(self, key: str, offset: int, length: int) -> bytes:
        raw = read_range(self.match(key), offset, length)
        self.reads, self.total_bytes, self.last = self.reads + 1, self.total_bytes + len(raw), (time.time(), len(raw))
        return raw


def byte_ranges(requests: DataFrame, files: dict[str, str]) -> DataFrame:
    """``requests`` (key, offset, length, ...) with payload: the bytes of the file that a key matches, fewer at its end.

    ``files`` are archives by name, under paths that all tasks see; each task opens them once and reads what its own
    rows ask for.  A key that matches none is an error.
    """

    def run(batches):
        open_files = Registry()
        for name, path in files.items():
            open_files.bind(name, path)
        for b in batches:
            asked = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "offset", "length"))
            found = [open_files.read(*x) for x in zip(*asked, strict=True)]
            yield b.append_column("payload", pa.array(found, pa.binary()))

    return requests.mapInArrow(run, StructType([*requests.schema, StructField("payload", BinaryType())]))


#: Regions that come with the engine: name, west, south, east, north (fixed values).
PRESETS = (
    ("innsbruck-area", 11.1, 47.1, 11.6, 47.45),
    ("innsbruck-wide", 10.9, 47.0, 11.8, 47.5),
    ("patscherkofel", 11.35, 47.15, 11.55, 47.25),
)
#: Places that come with the engine: name, region, longitude, latitude, zoom (fixed values).
PLACES = (
    ("Innsbruck Center", "Tyrol, Austria", 11.3908, 47.2757, 12),
    ("Nordkette Range", "Alps, Austria", 11.3794, 47.3061, 13),
    ("Patscherkofel", "Alps, Austria", 11.4619, 47.2086, 13),
)


def presets(spark: SparkSession) -> DataFrame:
    """region, west, south, east, north of the regions in the catalogue."""
    return spark.createDataFrame(list(PRESETS), "region string, west double, south double, east double, north double")


def places(spark: SparkSession) -> DataFrame:
    """name, region, lng, lat, zoom of the places in the catalogue."""
    return spark.createDataFrame(list(PLACES), "name string, region string, lng double, lat double, zoom int")


def hiking_query(south: float, west: float, north: float, east: float) -> str:
    """The question for hiking ways of a box."""
    box = f"({south},{west},{north},{east})"
    kinds = ('["highway"="path"]', '["highway"="footway"]', '["highway"="track"]["tracktype"~"grade[2-5]"]', '["route"="hiking"]')
    return "[out:json][timeout:25];(" + "".join(f"nwr{k}{box};" for k in kinds) + ");out geom;"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of captured responses, with a fixed schema."""
    return spark.read.schema(ELEMENTS).option("multiLine", True).json(path).selectExpr("inline(elements)")


def fetch_elements(boxes: DataFrame, endpoint: str, *, attempts: int = 3, wait_s: float = 1.0, timeout_s: float = 60.0) -> DataFrame:
    """Elements of the map-data server's answers for ``boxes`` (south, west, north, east), a request a row.

    Requests go out from the tasks, one after the other in each, so the number of parts of ``boxes`` bounds how many are
    under way.  Busy servers (429, 502, 503, 504) and broken connections are tried again after waits that double, other
    errors end the query.
    """

    def run(batches):
        def transient(e: Exception) -> bool:
            return e.code in (429, 502, 503, 504) if isinstance(e, urllib.error.HTTPError) else isinstance(e, OSError)

        def ask(box: tuple[float, float, float, float]) -> str:
            body = urllib.parse.urlencode({"data": hiking_query(*box)}).encode()
            with urllib.request.urlopen(urllib.request.Request(endpoint, data=body), timeout=timeout_s) as response:
                return response.read().decode("utf-8")

        for b in batches:
            answers = [retried(lambda box=box: ask(box), attempts, wait_s, transient) for box in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(answers, pa.string())], names=["body"])

    asked = boxes.select(*(F.col(c).cast("double").alias(c) for c in ("south", "west", "north", "east")))
    parsed = asked.mapInArrow(run, "body string").select(F.from_json("body", ELEMENTS).alias("r"))
    return parsed.selectExpr("inline(r.elements)")


def with_licence_header(path: str, header: str) -> bool:
    """Puts a header line before a text file unless one of its first three lines has it; says whether it did."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if any(header in line for line in body.split("\n")[:3]):
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{header}\n{body}")
    return True
