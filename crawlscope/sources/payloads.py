"""Records of landed JSON payloads of any size: one long array is read by many tasks.

A payload is a JSON object, on one line or many, in a folder `…/project_id=3/snapshot_id=12/`; its records are the objects of
one array, such as `pages`. Files are read in splits of spark.sql.files.maxPartitionBytes, wherever these cut. What a split
means depends on whether it begins inside a string and how deep it is nested, so the records are found in two passes:

1. Every split tells what it does to that state, once supposed to begin outside and once inside a string: the levels it closes,
   the keys it names, the levels it leaves open. Going through a file's splits in order then gives the state each begins in.
2. Every split, now knowing it, gives out the records that lie in it whole, and the ends of those that do not; the ends are put
   together by the split their record begins in.

Only Spark's own reader opens files, and no more than a record is ever held together.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text comes cut at closing braces, so a split never begins behind a backslash.
_CUT = "}"
# Names of payloads that are sent to every task.
FEW = 100_000
_TOKEN = re.compile(r'[{}\[\]]|"((?:[^"\\]|\\.)*+)("?)', re.DOTALL)
_REST = re.compile(r'((?:[^"\\]|\\.)*+)("?)', re.DOTALL)
_COLON = re.compile(r"\s*:")
# A level of nesting: what opened it, the last key named in it, and the split in which it was opened.
Level = tuple[str, str | None, int]


class Scan:
    """Goes through text and keeps its nesting: levels it has opened, levels closed below those, keys of the level it came from."""

    def __init__(self, inside: bool, levels: list[Level], split: int, field: str | None = None) -> None:
        self.inside, self.levels, self.split, self.field = inside, list(levels), split, field
        self.closed, self.key = 0, None  # of levels that were open before
        self.rest: list[str] = []  # an open record's text so far
        self.begun = self._in_record()

    def _in_array(self) -> bool:
        return len(self.levels) == 2 and self.levels[0][:2] == ("{", self.field) and self.levels[1][0] == "["

    def _in_record(self) -> bool:
        return len(self.levels) > 2 and self.levels[0][:2] == ("{", self.field) and self.levels[1][0] == "[" and self.levels[2][0] == "{"

    def _named(self, key: str | None) -> None:
        if self.levels:
            kind, _, split = self.levels[-1]
            self.levels[-1] = (kind, key, split)
        else:
            self.key = key

    def feed(self, text: str) -> Iterator[str]:
        """Texts of the records that end here; the first may be the end of one that began in an earlier split."""
        at, begin = 0, 0 if self.begun else None
        if self.inside:
            found = _REST.match(text)
            at = found.end()
            self.inside = not found[2]
            if not self.inside and _COLON.match(text, at):
                self._named(None)  # a key cut in two holds a closing brace, which no wanted key does
        while not self.inside and (found := _TOKEN.search(text, at)):
            token, at = found[0][0], found.end()
            if token == '"':
                self.inside = not found[2]
                if not self.inside and _COLON.match(text, at):
                    self._named(found[1])
            elif token in "{[":
                if self.field is not None and token == "{" and self._in_array():
                    begin = found.start()
                self.levels.append((token, None, self.split))
            elif self.levels:
                record = begin is not None and len(self.levels) == 3
                self.levels.pop()
                if record:
                    self.rest.append(text[begin:at])
                    yield "".join(self.rest)
                    self.rest, begin = [], None
            else:
                self.closed, self.key = self.closed + 1, None
        if begin is not None:
            self.rest.append(text[begin:])
        self.begun = begin is not None


def after(levels: list[Level], closed: int, key: str | None, opened: list[Level]) -> list[Level]:
    """The levels open behind a split that begins at `levels`. What closes more than is open, between payloads, closes nothing."""
    levels = levels[: max(0, len(levels) - closed)]
    if levels and key is not None:
        levels[-1] = (levels[-1][0], key, levels[-1][2])
    return [*levels, *opened]


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, str]]:
    """First row and text of consecutive pieces of one split."""
    for frame in frames:
        change = (frame["_file"] != frame["_file"].shift()) | (frame["_split"] != frame["_split"].shift())
        for _, run in frame.groupby(change.cumsum(), sort=False):
            yield run.iloc[:1], _CUT.join([*run["value"], ""])


def _summaries(names: list[str]):
    """Per split, both suppositions: (inside at the end, levels closed, key, levels opened) as JSON."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scans: dict[tuple, list[Scan]] = {}
        for first, text in _runs(frames):
            at = tuple(first[c].iloc[0] for c in (*names, "_file", "_split"))
            both = scans.setdefault(at, [Scan(False, [], int(at[-1])), Scan(True, [], int(at[-1]))])
            for scan in both:
                for _ in scan.feed(text):
                    pass
        rows = [(*at, *[json.dumps([s.inside, s.closed, s.key, s.levels]) for s in both]) for at, both in scans.items()]
        yield pd.DataFrame(rows, columns=[*names, "_file", "_split", "_outside", "_inside"])

    return run


def _states(frame: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of a file begins."""
    inside, levels, rows = False, [], []
    for row in frame.sort_values("_split").itertuples(index=False):
        rows.append((row[0], row[1], json.dumps([inside, levels])))
        ends, closed, key, opened = json.loads(row[3] if inside else row[2])
        inside, levels = ends, after([tuple(v) for v in levels], closed, key, [tuple(v) for v in opened])
    return pd.DataFrame(rows, columns=["_file", "_split", "_state"])


def _records(field: str, names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan: Scan | None = None
        at, kept, number, owner = None, {}, 0, None

        def row(owner: int | None, number: int, text: str) -> tuple:
            return (*kept.values(), at[0], at[1], number, owner, text)

        for first, text in _runs(frames):
            out = []
            here = first["_file"].iloc[0], int(first["_split"].iloc[0])
            if here != at:
                if scan is not None and scan.begun:
                    out.append(row(scan.levels[2][2], number, "".join(scan.rest)))
                inside, levels = json.loads(first["_state"].iloc[0])
                at, number = here, 0
                kept = {c: first[c].iloc[0] for c in names}
                scan = Scan(inside, [tuple(v) for v in levels], here[1], field)
                owner = scan.levels[2][2] if scan.begun else None
            for record in scan.feed(text):
                out.append(row(owner, number, record))
                number, owner = number + 1, None
            if out:
                yield pd.DataFrame(out, columns=[*names, "_file", "_split", "_number", "_owner", "_text"])
        if scan is not None and scan.begun:
            yield pd.DataFrame([row(scan.levels[2][2], number, "".join(scan.rest))], columns=[*names, "_file", "_split", "_number", "_owner", "_text"])

    return run


def record_texts(spark: SparkSession, path: str, field: str, only: DataFrame | None = None) -> DataFrame:
    """The folder columns of the payloads below `path`, and of each object in the array `field` of the payload's own level its `text`
    and its `place` (file, split, number), by which records of a payload are ordered.

    A file may hold several payloads one after another. Records that are no objects are left out. A payload that breaks off
    gives its whole records, and the broken one closed at its last brace. `only` (some folder columns) names the payloads to
    read; up to FEW of them go to every task, so that Spark lists and reads just their folders, and more are met split by split.
    """
    text = spark.read.option("lineSep", _CUT).option("recursiveFileLookup", "false").text(path)
    names = [c for c in text.columns if c != "value"]
    pieces = text.select(*names, "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    few = only is not None and only.limit(FEW + 1).count() <= FEW
    if few:
        pieces = pieces.join(F.broadcast(only), only.columns, "left_semi")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in text.schema.fields if f.name != "value")
    summaries = pieces.mapInPandas(_summaries(names), f"{kinds}_file string, _split long, _outside string, _inside string")
    if only is not None and not few:
        summaries = summaries.join(only, only.columns, "left_semi")
    states = summaries.select("_file", "_split", "_outside", "_inside").groupBy("_file").applyInPandas(_states, "_file string, _split long, _state string")
    # pieces keep their order within a split: the sort by place is stable, whichever way the states arrive
    known = pieces.withColumn("_at", F.monotonically_increasing_id()).join(states, ["_file", "_split"]).sortWithinPartitions("_file", "_split", "_at")
    found = known.select(*names, "value", "_file", "_split", "_state").mapInPandas(
        _records(field, names), f"{kinds}_file string, _split long, _number int, _owner long, _text string")
    place = F.struct(F.col("_file").alias("file"), F.col("_split").alias("split"), F.col("_number").alias("number")).alias("place")
    whole = found.filter("_owner IS NULL").select(*names, F.col("_text").alias("text"), place)
    parts = F.array_sort(F.collect_list(F.struct("_split", "_number", "_text")))
    joined = found.filter("_owner IS NOT NULL").groupBy(*names, "_file", "_owner").agg(parts.alias("_p")).select(
        *names, F.array_join("_p._text", "").alias("text"),
        F.struct(F.col("_file").alias("file"), F.col("_owner").alias("split"), F.get("_p", F.lit(0))["_number"].alias("number")).alias("place"))
    return whole.unionByName(joined)


def read_records(spark: SparkSession, path: str, field: str, schema: str, only: DataFrame | None = None) -> DataFrame:
    """Folder columns, the parsed columns of each record by the DDL struct `schema`, and `place`."""
    texts = record_texts(spark, path, field, only)
    names = [c for c in texts.columns if c not in ("text", "place")]
    return texts.select(*names, F.from_json("text", schema).alias("_r"), "place").select(*names, "_r.*", "place")


def newest_payloads(index: DataFrame, collector: str) -> DataFrame:
    """project_id and snapshot_id of the newest usable payload per site. `index` lists payloads without their text."""
    usable = index.filter((F.col("collector") == collector) & F.col("status").isin("ok", "partial"))
    return usable.groupBy("project_id").agg(F.max("snapshot_id").alias("snapshot_id"))


def last_of(records: DataFrame, keys: list[str]) -> DataFrame:
    """One record per key: of those a payload repeats, the one that stands last."""
    values = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*values), "place").alias("_r"))
    return last.select(*keys, "_r.*")
