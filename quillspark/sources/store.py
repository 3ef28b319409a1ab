"""A versioned index on disk: immutable segments, and commits that list them.

    root/s-<id>/docs, /postings, /terms    a segment: documents added by one commit
    root/d-<id>/docs, /terms               documents taken away by one, and what their terms counted
    root/v-<n>/manifest.json               a commit: its segments, what is taken from each, and their files
    root/pins/<n>-<name>                   snapshots, which keep a commit

A commit writes what it adds or takes away, never what was there before; compact()
makes one segment of all. Statistics count living documents: terms taken away are
subtracted. A commit without a readable manifest doesn't exist: a job that dies on the way
leaves nothing that a reader sees, and the newest readable one counts. All files
go through Hadoop's filesystem, so root may be on any store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyser
from ..operators import index as I
from ..plans.compile import compile
from ..plans.query import Query, Term

FORMAT = 2
CODECS = ("none", "lz4", "zstd", "gzip", "snappy", "brotli")
#: Commits (oldest first, with their manifests' notes) to those to keep; pinned ones stay anyway.
Policy = Callable[[list[tuple[int, str]]], list[int]]


def keep_last(n: int) -> Policy:
    """The newest n commits."""
    if n < 1:
        raise ValueError("at least one commit stays")
    return lambda found: [v for v, _ in found[-n:]]


def keep_all(found: list[tuple[int, str]]) -> list[int]:
    """All commits."""
    return [v for v, _ in found]


class StoreError(RuntimeError):
    """A store that can't be read, or a conflict between writers."""


class Files:
    """Hadoop's filesystem at a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def sizes(self, p: str) -> dict[str, int]:
        """Bytes of each file below a folder, by its path from there."""
        out, it = {}, self.fs.listFiles(self.path(p), True)
        base = self.fs.makeQualified(self.path(p)).toString() + "/"
        while it.hasNext():
            s = it.next()
            if not s.getPath().getName().startswith("."):
                out[s.getPath().toString().removeprefix(base)] = s.getLen()
        return out

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes())
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        """A file that appears at once or not at all, and never replaces another."""
        part = f"{p}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(p) or not self.fs.rename(self.path(part), self.path(p)):
            self.fs.delete(self.path(part), False)
            raise StoreError(f"{p} was written by another")

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def copy(self, a: str, b: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(a), self.path(b).getFileSystem(self.conf), self.path(b), False, self.conf)


def sealed(manifest: dict) -> str:
    """A manifest as it's written, with its checksum."""
    body = json.dumps(manifest, sort_keys=True)
    return json.dumps({"body": body, "crc32": zlib.crc32(body.encode())})


def unsealed(raw: bytes) -> dict:
    """A manifest as it was, if its checksum holds."""
    outer = json.loads(raw)
    if zlib.crc32(outer["body"].encode()) != outer["crc32"]:
        raise ValueError("checksum")
    return json.loads(outer["body"])


@dataclass(frozen=True)
class Store:
    """A store at root; text and exact are its analysed and verbatim fields. sort
    orders the documents inside a segment's files; codec compresses them. keep is the number of
    commits that stay, or a policy that chooses them."""

    spark: SparkSession
    root: str
    text: dict[str, Analyser]
    exact: tuple[str, ...] = ()
    codec: str = "zstd"
    sort: tuple[str, ...] = ()
    keep: int | Policy = 1

    def __post_init__(self) -> None:
        if self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec}")

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def _at(self, version: int) -> str:
        return f"{self.root}/v-{version:08d}"

    # --- reading

    def versions(self) -> list[int]:
        """The commits that can be read, oldest first."""
        return [v for v, _ in self._commits()]

    def _commits(self) -> list[tuple[int, dict]]:
        out = []
        for name in self.files.names(self.root):
            if name.startswith("v-"):
                try:
                    out.append((int(name[2:]), self.manifest(int(name[2:]))))
                except (StoreError, ValueError):
                    continue
        return out

    def manifest(self, version: int) -> dict:
        try:
            m = unsealed(self.files.read(f"{self._at(version)}/manifest.json"))
        except Exception as e:  # missing, torn or altered
            raise StoreError(f"commit {version} can't be read") from e
        if m["format"] != FORMAT:
            raise StoreError(f"commit {version} has format {m['format']}, not {FORMAT}")
        if m["version"] != version:
            raise StoreError(f"commit {version} says it's {m['version']}")
        return m

    def latest(self) -> int:
        found = self.versions()
        if not found:
            raise StoreError(f"{self.root} has no commit that can be read")
        return found[-1]

    def _living(self, m: dict, table: str, schema: str) -> DataFrame:
        """The rows of a table of all segments whose documents are alive. Segments that
        lost the same documents are read together."""
        alike: dict[tuple[str, ...], list[str]] = {}
        for s in m["segments"]:
            alike.setdefault(tuple(s["gone"]), []).append(s["name"])
        parts = []
        for gone, names in alike.items():
            x = self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}/docs" for n in names)) if table == "docs" else self._fields(names, table, schema)
            if gone:
                x = x.join(self._ids(gone), "doc_id", "left_anti").select(*x.columns)
            parts.append(x)
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)

    def _fields(self, names: list[str], table: str, schema: str) -> DataFrame:
        """A table of some segments or losses, which is partitioned by field."""
        columns = [c.split()[0] for c in schema.split(", ")]
        return reduce(DataFrame.union, (self.spark.read.schema(schema).parquet(f"{self.root}/{n}/{table}").select(*columns) for n in names))

    def _ids(self, gone: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema("doc_id bigint").parquet(*(f"{self.root}/{n}/docs" for n in gone))

    def docs(self, version: int | None = None) -> DataFrame:
        m = self.manifest(self.latest() if version is None else version)
        return self._living(m, "docs", m["schema"])

    def index(self, version: int | None = None) -> I.Index:
        """The index of a commit, the latest by default."""
        m = self.manifest(self.latest() if version is None else version)
        terms = [self._fields([s["name"] for s in m["segments"]], "terms", I.TERMS)] if m["segments"] else [self.spark.createDataFrame([], I.TERMS)]
        if m["losses"]:
            terms.append(self._fields(list(m["losses"]), "terms", I.TERMS).select("field", "term", -F.col("df"), -F.col("cf")))
        t = terms[0]
        if len(m["segments"]) + len(m["losses"]) > 1:
            t = reduce(DataFrame.union, terms).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        n, lengths = self._totals(m)
        return I.Index(self._living(m, "docs", m["schema"]), self._living(m, "postings", I.POSTINGS), t, n, I.averages(self.text, n, lengths), self.text)

    @staticmethod
    def _totals(m: dict) -> tuple[int, dict[str, int]]:
        """Living documents, and tokens of each text field."""
        lengths: dict[str, int] = {}
        for sign, parts in ((1, m["segments"]), (-1, m["losses"].values())):
            for x in parts:
                for f, n in x["lengths"].items():
                    lengths[f] = lengths.get(f, 0) + sign * n
        return sum(s["n"] for s in m["segments"]) - sum(x["n"] for x in m["losses"].values()), lengths

    # --- writing

    def _crcs(self, names: list[str]) -> dict[str, list[int]]:
        """Bytes and CRC-32 of each data file of folders, by its path below root; summed on the executors."""
        if not names:
            return {}
        base = self.files.fs.makeQualified(self.files.path(self.root)).toString() + "/"
        paths = [f"{base}{n}" for n in names]
        x = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
        rows = x.select("path", "length", F.crc32("content").alias("crc")).collect()  # a row for each file
        return {_below(r.path, base): [r.length, r.crc] for r in rows}

    def _segment(self, docs: DataFrame) -> dict:
        """Writes a segment of docs: its name, documents, and tokens of each text field that they have."""
        name = f"s-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        x = docs.where("doc_id is not null")
        x = x.sortWithinPartitions(*self.sort) if self.sort else x
        x.write.option("compression", self.codec).parquet(f"{at}/docs")
        stored = self.spark.read.schema(docs.schema).parquet(f"{at}/docs")
        n, kinds = stored.agg(F.count("*"), F.countDistinct("doc_id")).first()
        if n != kinds:
            self.files.remove(at)
            raise StoreError(f"{n - kinds} rows repeat a doc_id")
        text, exact = {f: a for f, a in self.text.items() if f in docs.columns}, tuple(f for f in self.exact if f in docs.columns)
        lengths = {r.field: r.sum_len for r in I.write_postings(stored, text, exact, at, n).collect()} if text or exact else {}
        return {"name": name, "n": n, "lengths": lengths, "gone": []}

    def _loss(self, m: dict, ids: DataFrame) -> tuple[str, dict] | None:
        """Writes the living documents among ids as taken away, with what their terms counted."""
        name = f"d-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        gone = self._living(m, "docs", m["schema"]).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        gone.select("doc_id").write.option("compression", self.codec).parquet(f"{at}/docs")
        dead = self.spark.read.schema("doc_id bigint").parquet(f"{at}/docs")
        n = dead.count()
        if not n:
            self.files.remove(at)
            return None
        t = self._living(m, "postings", I.POSTINGS).join(dead, "doc_id", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        t.sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{at}/terms")
        lengths = self.spark.read.schema(I.TERMS).parquet(f"{at}/terms").where(F.col("field").isin(*self.text)).groupBy("field").agg(F.sum("cf").alias("n")).collect()
        return name, {"n": n, "lengths": {r.field: r.n for r in lengths}}

    def _change(self, note: str, add: DataFrame | None = None, gone: DataFrame | None = None, afresh: bool = False) -> int:
        """A new commit: the latest without gone (doc_id), with add; afresh: nothing of the latest."""
        found = self._commits()
        m = found[-1][1] if found and not afresh else {"segments": [], "losses": {}, "files": {}, "schema": None}
        segments, losses, files, new = [dict(s) for s in m["segments"]], dict(m["losses"]), dict(m["files"]), []
        if gone is not None and segments and (lost := self._loss(m, gone)):
            losses[lost[0]] = lost[1]
            segments = [s | {"gone": [*s["gone"], lost[0]]} for s in segments]
            new.append(lost[0])
        schema = m["schema"]
        if add is not None:
            schema = _merged(self.spark, schema, add._jdf.schema().toDDL())
            s = self._segment(add)
            if segments:
                after = self._living({"segments": segments}, "docs", "doc_id bigint")
                both = after.join(self.spark.read.schema("doc_id bigint").parquet(f"{self.root}/{s['name']}/docs"), "doc_id", "left_semi")
                if (n := both.count()) > 0:
                    for name in [s["name"], *new]:
                        self.files.remove(f"{self.root}/{name}")
                    raise StoreError(f"{n} rows repeat a doc_id")
            segments.append(s)
            new.append(s["name"])
        files |= self._crcs(new)
        v = 1 + max([0, *(int(n[2:]) for n in self.files.names(self.root) if n.startswith("v-"))])
        n, _ = self._totals({"segments": segments, "losses": losses})
        body = {"format": FORMAT, "version": v, "parent": found[-1][0] if found else None, "note": note, "n_docs": n, "schema": schema or "doc_id bigint", "segments": segments, "losses": losses, "files": files}
        self.files.write(f"{self._at(v)}/manifest.json", sealed(body))
        self.vacuum()
        return v

    def commit(self, docs: DataFrame, note: str = "") -> int:
        """A new commit that holds docs (doc_id and fields) and nothing else; the older ones that the
        policy doesn't keep, and no snapshot pins, go. Two rows of a doc_id are an error."""
        return self._change(note, docs, afresh=True)

    def add(self, docs: DataFrame) -> int:
        """Adds documents as a segment; a doc_id that's there already is an error."""
        return self._change("add", docs)

    def upsert(self, docs: DataFrame, note: str = "upsert") -> int:
        """Adds documents in the place of those with their doc_ids."""
        return self._change(note, docs, docs.select("doc_id"))

    def add_blocks(self, children: DataFrame, parents: DataFrame) -> int:
        """Adds blocks: children and parents with doc_id and block_id, each block one parent and at least a child."""
        sizes = children.select("block_id", F.lit(0).alias("p")).union(parents.select("block_id", F.lit(1).alias("p"))).groupBy("block_id").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
        if bad := sizes.where("p <> 1 or n < 2").take(1):
            raise StoreError(f"block {bad[0].block_id} isn't one parent with children")
        return self.add(children.withColumn("is_parent", F.lit(False)).unionByName(parents.withColumn("is_parent", F.lit(True)), allowMissingColumns=True))

    def delete(self, query: Query) -> int:
        """Without the documents that a query matches. Statistics count the living only."""
        return self._change("delete", gone=compile(query, self.index(), False))

    def remove(self, ids: DataFrame) -> int:
        """Without the documents of a table of ids (doc_id); others in it don't count."""
        return self._change("delete", gone=ids)

    def update(self, field: str, term: str, docs: DataFrame) -> int:
        """Without the documents that have a term, with docs; the new ones aren't looked at."""
        return self._change("update", docs, compile(Term(field, term), self.index(), False))

    def compact(self, partitions: int) -> int:
        """The same documents as one segment of so many files (sorted, if the store sorts)."""
        docs = self.docs()
        return self._change("compact", docs.repartitionByRange(partitions, *self.sort) if self.sort else docs.repartition(partitions, "doc_id"), afresh=True)

    def uncommitted(self, docs: DataFrame) -> I.Index:
        """The index as it would be with docs added: a view of documents that no commit holds yet."""
        own = I.build(docs, self.text, self.exact)
        if not self.versions():
            return own
        ix = self.index()
        both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        t = both(ix.terms, own.terms).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        n = ix.n_docs + own.n_docs
        lengths = {f: round(ix.avgdl.get(f, 0) * ix.n_docs + own.avgdl.get(f, 0) * own.n_docs) for f in self.text}
        return I.Index(both(ix.docs, own.docs), both(ix.postings, own.postings), t, n, I.averages(self.text, n, lengths), self.text)

    def rollback(self) -> list[int]:
        """Removes what no commit owns, as jobs that died leave it. Not while another writes."""
        good, gone = self.versions(), []
        for name in self.files.names(self.root):
            if name.startswith("v-") and int(name[2:]) not in good:
                self.files.remove(f"{self.root}/{name}")
                gone.append(int(name[2:]))
        self._sweep()
        return gone

    def _sweep(self) -> None:
        """Removes the segments and losses that no commit lists."""
        used = {n for _, m in self._commits() for n in _folders(m)}
        for name in self.files.names(self.root):
            if name[:2] in ("s-", "d-") and name not in used:
                self.files.remove(f"{self.root}/{name}")

    # --- snapshots and retention

    def snapshot(self, name: str) -> int:
        """Pins the latest commit under a name."""
        v = self.latest()
        self.files.write(f"{self.root}/pins/{v:08d}-{name}", "{}")
        return v

    def snapshots(self) -> dict[str, int]:
        return {n[9:]: int(n[:8]) for n in self.files.names(f"{self.root}/pins")}

    def release(self, name: str) -> None:
        self.files.remove(f"{self.root}/pins/{self.snapshots()[name]:08d}-{name}")

    def vacuum(self) -> list[int]:
        """Removes all commits but those that the policy keeps and the pinned ones, and the
        segments that only they listed. The newest commit always stays."""
        found = self._commits()
        policy = keep_last(self.keep) if isinstance(self.keep, int) else self.keep
        stay = {*policy([(v, m["note"]) for v, m in found]), *self.snapshots().values(), *(v for v, _ in found[-1:])}
        gone = [(v, m) for v, m in found if v not in stay]
        used = {n for v, m in found if v in stay for n in _folders(m)}
        for v, _ in gone:
            self.files.remove(self._at(v))
        for name in {n for _, m in gone for n in _folders(m)} - used:
            self.files.remove(f"{self.root}/{name}")
        return [v for v, _ in gone]

    # --- care

    def size(self, version: int | None = None) -> DataFrame:
        """(part, files, bytes) of a commit."""
        m = self.manifest(self.latest() if version is None else version)
        rows: dict[str, list[int]] = {"manifest.json": [1, self.files.sizes(self._at(m["version"]))["manifest.json"]]}
        for name, (n, _) in m["files"].items():
            folder, part = name.split("/")[:2]
            r = rows.setdefault("losses" if folder.startswith("d-") else part, [0, 0])
            r[0], r[1] = r[0] + 1, r[1] + n
        return self.spark.createDataFrame([(k, *r) for k, r in sorted(rows.items())], "part string, files bigint, bytes bigint")

    def check(self, version: int | None = None, deep: bool = True) -> list[tuple[str, str]]:
        """(code, message) of what is wrong with a commit; nothing if it's sound.
        Not deep: the manifest and the files' sizes only; deep: their checksums, and what the tables say of each other."""
        try:
            v = self.latest() if version is None else version
            m = self.manifest(v)
        except StoreError as e:
            return [("no-commit", str(e))]
        out = []
        have = {f"{f}/{k}": n for f in _folders(m) for k, n in (self.files.sizes(f"{self.root}/{f}") if self.files.exists(f"{self.root}/{f}") else {}).items() if k.endswith(".parquet")}
        for name, (n, _) in sorted(m["files"].items()):
            if name not in have:
                out.append(("file-missing", name))
            elif have[name] != n:
                out.append(("file-size", f"{name}: {have[name]} bytes, not {n}"))
        out += [("file-unknown", name) for name in sorted(have.keys() - m["files"].keys())]
        for s in m["segments"]:
            out += [("loss-unknown", f"{s['name']} lost {g}") for g in s["gone"] if g not in m["losses"]]
        if m["n_docs"] != self._totals(m)[0]:
            out.append(("manifest-count", f"{m['n_docs']} documents, not {self._totals(m)[0]}"))
        if not deep or any(c in ("file-missing", "loss-unknown") for c, _ in out):
            return out
        sums = self._crcs(_folders(m))
        out += [("file-checksum", name) for name, (n, crc) in sorted(m["files"].items()) if have[name] == n and sums[name][1] != crc]
        if any(c in ("file-checksum", "file-size") for c, _ in out):
            return out  # the tables may not be readable
        ix = self.index(v)
        p = ix.postings
        lengths = p.where(F.col("field").isin(*self.text)).groupBy("field", "doc_id").agg(F.sum("tf").alias("n"), F.min("dl").alias("lo"), F.max("dl").alias("hi"))
        counted = p.groupBy("field", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("m")).join(ix.terms, ["field", "term"], "full")
        dead = [self._ids((g,)).count() != x["n"] for g, x in m["losses"].items()]
        tokens = {r.field: r.n for r in lengths.groupBy("field").agg(F.sum("n").alias("n")).collect()}
        tests = {
            "doc-count": ix.docs.count() != m["n_docs"],
            "doc-null": bool(ix.docs.where("doc_id is null").take(1)),
            "doc-repeated": bool(ix.docs.groupBy("doc_id").count().where("count > 1").take(1)),
            "loss-count": any(dead),
            "posting-orphan": bool(p.join(ix.docs.select("doc_id"), "doc_id", "left_anti").take(1)),
            "posting-repeated": bool(p.groupBy("field", "term", "doc_id").count().where("count > 1").take(1)),
            "posting-field": bool(p.where(~F.col("field").isin(*self.text, *self.exact)).take(1)) if self.text or self.exact else False,
            "posting-empty": bool(p.where("term is null or term = '' or tf < 1").take(1)),
            "posting-frequency": bool(p.where((F.size("positions") > 0) & (F.size("positions") != F.col("tf"))).take(1)),
            "posting-order": bool(p.where(F.array_sort(F.array_distinct("positions")) != F.col("positions")).take(1)),
            "posting-place": bool(p.where((F.size("positions") > 0) & ((F.array_min("positions") < 0) | (F.array_max("positions") >= F.col("dl")))).take(1)),
            "length": bool(lengths.where("n <> lo or lo <> hi").take(1)),
            "length-total": any(tokens.get(f, 0) != n for f, n in self._totals(m)[1].items()),
            "term-frequency": bool(counted.where("not (n <=> df)").take(1)),
            "term-occurrences": bool(counted.where("not (m <=> cf)").take(1)),
            "term-repeated": bool(ix.terms.groupBy("field", "term").count().where("count > 1").take(1)),
        }
        return out + [(code, "found") for code, bad in tests.items() if bad]

    def backup(self, to: str, version: int | None = None) -> str:
        """Copies a sound commit, its files' checksums looked at, to a folder that mustn't exist."""
        v = self.latest() if version is None else version
        if bad := self.check(v, deep=False):
            raise StoreError(f"commit {v} isn't sound: {bad[0]}")
        m, files = self.manifest(v), self.files
        if bad := [n for n, x in self._crcs(_folders(m)).items() if m["files"].get(n) != x]:
            raise StoreError(f"commit {v} isn't sound: {bad[0]} is altered")
        if files.exists(to):
            raise StoreError(f"{to} exists")
        for name in _folders(m):
            files.copy(f"{self.root}/{name}", f"{to}/{name}")
        files.write(f"{to}/manifest.json", sealed(m))
        return to

    def restore(self, source: str) -> int:
        """Copies a backup into the store as its newest commit, after a look at its manifest and checksums."""
        files = self.files
        try:
            m = unsealed(files.read(f"{source}/manifest.json"))
        except Exception as e:
            raise StoreError(f"{source} isn't a backup") from e
        if m["format"] != FORMAT:
            raise StoreError(f"{source} has format {m['format']}, not {FORMAT}")
        have = replace(self, root=source)._crcs([n for n in _folders(m) if files.exists(f"{source}/{n}")])
        if bad := [n for n, x in m["files"].items() if have.get(n) != x]:
            raise StoreError(f"{source}: {bad[0]} is missing or altered")
        for name in _folders(m):
            if not files.exists(f"{self.root}/{name}"):
                part = f"{self.root}/restoring-{uuid.uuid4().hex}"
                files.copy(f"{source}/{name}", part)
                files.fs.rename(files.path(part), files.path(f"{self.root}/{name}"))
        v = 1 + max([0, *(int(n[2:]) for n in files.names(self.root) if n.startswith("v-"))])
        files.write(f"{self._at(v)}/manifest.json", sealed(m | {"version": v, "note": "restore"}))
        return v

    def inspect(self) -> list[dict]:
        """The manifests of all commits, without their files."""
        return [{k: x for k, x in m.items() if k != "files"} for _, m in self._commits()]

    def compat(self) -> list[dict]:
        """For each commit folder whether this format can read it, and its format if it tells one."""
        out = []
        for name in self.files.names(self.root):
            if name.startswith("v-"):
                try:
                    kind = unsealed(self.files.read(f"{self.root}/{name}/manifest.json"))["format"]
                except Exception:  # torn or altered
                    kind = None
                out.append({"version": int(name[2:]), "format": kind, "readable": kind == FORMAT, "migrates": kind == 1})
        return out

    def migrate(self) -> int:
        """The newest commit as one of this format: one of format 1, a folder of tables
        beside its manifest, is indexed again. A store of this format stays as it is."""
        found = [x for x in self.compat() if x["readable"] or x["migrates"]]
        if not found:
            raise StoreError(f"{self.root} has no commit of a known format")
        last = found[-1]
        if last["readable"]:
            return last["version"]
        old = unsealed(self.files.read(f"{self._at(last['version'])}/manifest.json"))
        docs = self.spark.read.schema(old["schema"]).parquet(f"{self._at(last['version'])}/docs")
        return self._change("migrate", docs, afresh=True)

    def with_policy(self, keep: int | Policy) -> Store:
        """The store keeping so many commits, or what a policy chooses."""
        if isinstance(keep, int):
            keep_last(keep)
        return replace(self, keep=keep)


def _folders(m: dict) -> list[str]:
    return [s["name"] for s in m["segments"]] + list(m["losses"])


def _below(path: str, base: str) -> str:
    """A file's path below a folder; schemes may be written file:/ or file:///."""
    plain = lambda p: p.split(":", 1)[-1].lstrip("/")
    return plain(path).removeprefix(plain(base))


def _merged(spark: SparkSession, a: str | None, b: str) -> str:
    """The columns of both schemas; one of two types is an error."""
    if a is None or a == b:
        return b
    empty = lambda s: spark.createDataFrame([], s)
    types = dict(empty(a).dtypes)
    if bad := [c for c, kind in empty(b).dtypes if types.get(c, kind) != kind]:
        raise StoreError(f"column {bad[0]} has another type")
    return empty(a).unionByName(empty(b), allowMissingColumns=True)._jdf.schema().toDDL()
