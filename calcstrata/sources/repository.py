"""A repository of simulation files: stage, commit, history, diff, status, reproduce.

Tables are folders of Parquet under the working tree's store, which may lie on
any file system. What belongs to them is told by versions (see ``manifest``):
blobs, diffs, outputs, commits, the staging index and the head change together
or not at all, of two writers that start from one version the second fails,
and readers keep to the version that they found.
"""

from __future__ import annotations

import getpass
import platform
import posixpath
import re
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators import blobs, commits, diff, facts, files, snapshots, staging
from ..parsers import registry
from ..plugins import Manager
from ..schemas import BlobCorruptedError, BlobNotFoundError, RepositoryError, StagingError
from . import tree, worktree
from .blobstore import BlobStore
from .files import Files
from .manifest import Manifest

TABLES = ("blobs", "commits", "diffs", "outputs")
#: So many folders of a table are merged into one by the next commit.
MERGED_FROM = 64
#: Problems that an error message names.
SHOWN = 20


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/") if "://" in root else str(Path(root).resolve())
        self.store = f"{self.root}/{worktree.STORE}"
        self._at = self.store if "://" in self.store else f"file://{self.store}"
        self._tree = Files(spark, self.root if "://" in self.root else f"file://{self.root}")
        self._files = Files(spark, self._at)
        self._versions = Manifest(spark, self._at)
        self._manager: Manager | None = None

    # state and tables

    def init(self, force: bool = False) -> Repository:
        if self._files.exists():
            if not force:
                raise RepositoryError(f"{self.root} is a repository already")
            self._files.delete()
        fresh = not self._tree.exists(worktree.IGNORE_FILE)
        try:
            self._files.make()
            self._versions.create({"version": schemas.VERSION, "head": None, "staged": None, "tables": {t: [] for t in TABLES}})
            if fresh:
                self._tree.put(worktree.IGNORE_FILE, "# patterns of files that are not added\n__pycache__/\n*.tmp\n")
        except Exception:  # nothing half made stays
            self._files.delete()
            if fresh:
                self._tree.delete(worktree.IGNORE_FILE)
            raise
        return self

    def schema_version(self) -> int:
        """Version of the stored layout; 0 if none is recorded."""
        if not self._versions.latest():
            return 0
        try:
            return int(self._versions.read()[1].get("version") or 0)
        except (RepositoryError, ValueError, AttributeError):
            return 0

    def manager(self) -> Manager:
        """Plug-ins that installed packages offer, with this repository's settings; what they add to the parsers is in force from here on."""
        if self._manager is None:
            self._manager = Manager("plugins.json", self._files)
            self._manager.discover()
        return self._manager

    def _read(self) -> tuple[int, dict]:
        """The newest version and its state."""
        version = self._versions.latest()
        if not version:
            raise RepositoryError(f"{self.root} is no repository")
        version, state = self._versions.read(version)
        if state.get("version") != schemas.VERSION:
            raise RepositoryError("the store has another version")
        return version, state

    def _state(self) -> dict:
        return self._read()[1]

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self._at}/{p}" for p in paths))

    def table(self, name: str, schema: str, state: dict | None = None) -> DataFrame:
        return self._load([f"{name}/{x}" for x in (state or self._state())["tables"][name]], schema)

    def _appended(self, state: dict, name: str, schema: str, rows: DataFrame) -> list[str]:
        """The folders of a table with one more, which nobody sees before a version names it; many are merged."""
        own = state["tables"][name]
        folder = Manifest.folder()
        columns = [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]
        if len(own) >= MERGED_FROM:
            rows, own = self.table(name, schema, state).unionByName(rows.select(*columns)).coalesce(8), []
        rows.select(*columns).write.parquet(f"{self._at}/{name}/{folder}")
        return [*own, folder]

    def blob_store(self, state: dict | None = None) -> BlobStore:
        return BlobStore(self.spark, f"{self._at}/blobs", (state or self._state())["tables"]["blobs"])

    def commits(self) -> DataFrame:
        return self.table("commits", schemas.COMMITS)

    def staged(self, state: dict | None = None) -> DataFrame:
        folder = (state or self._state())["staged"]
        return self._load([f"staged/{folder}"] if folder else [], schemas.STAGED)

    def _stage(self, version: int, state: dict, df: DataFrame | None) -> None:
        folder = None
        if df is not None:
            folder = Manifest.folder()
            df.select("path", "blob_hash", "size_bytes", "mtime", "file_type").write.parquet(f"{self._at}/staged/{folder}")
        self._versions.publish(version, state | {"staged": folder})

    def vacuum(self) -> list[str]:
        """Delete what failed and dead writers left; only for times without writers."""
        gone = self._versions.vacuum(["commits", "diffs", "outputs", "staged"])
        for name in ("scans", "reports"):
            self._files.delete(name)
        named = {e["tx"] for n in self._files.names("versions") if n.endswith(".json") for e in self._versions.read(int(n[:-5]))[1]["tables"]["blobs"]}
        for n in self._files.names("blobs"):
            if n.startswith("tx=") and n[3:] not in named:
                self._files.delete(f"blobs/{n}")
                gone.append(f"blobs/{n}")
        return gone

    def compact(self) -> bool:
        """Merge the folders of the blob store; whether there was something to merge."""
        version, state = self._read()
        merged = self.blob_store(state).compacted()
        if merged is None:
            return False
        self._versions.publish(version, state | {"tables": state["tables"] | {"blobs": merged}})
        return True

    # blobs

    def read_blob(self, blob_hash: str, verify: bool = True) -> bytes:
        found = self.blob_store().find(self._hash(blob_hash))
        row = found.select("content", (S.sha256_hex(F.col("content")) == blob_hash.lower()).alias("ok")).first()
        if row is None:
            raise BlobNotFoundError(blob_hash)
        if verify and not row["ok"]:
            raise BlobCorruptedError(blob_hash)
        return bytes(row["content"])

    def _hash(self, blob_hash: str) -> DataFrame:
        return self.spark.createDataFrame([(blob_hash,)], "blob_hash string")

    def blob_exists(self, blob_hash: str) -> bool:
        return not self.blob_store().rows_of(self._hash(blob_hash)).isEmpty()

    def blob_size(self, blob_hash: str) -> dict:
        """size_bytes, stored_bytes and codec of one blob."""
        row = self.blob_store().sizes(self._hash(blob_hash)).first()
        if row is None:
            raise BlobNotFoundError(blob_hash)
        return row.asDict()

    def stored_size(self) -> int:
        """Bytes of all blobs as they are stored."""
        return self.blob_store().sizes().agg(F.coalesce(F.sum("stored_bytes"), F.lit(0))).first()[0]

    # staging

    def _inside(self, path: str) -> str:
        if "://" in self.root:
            inner = posixpath.normpath(path.removeprefix(self.root).lstrip("/") or ".")
            if inner.startswith("..") or "://" in path.removeprefix(self.root):
                raise StagingError(f"{path} is outside of {self.root}")
            return inner
        full = Path(self.root, path).resolve()
        if full != Path(self.root) and Path(self.root) not in full.parents:
            raise StagingError(f"{path} is outside of {self.root}")
        return full.relative_to(self.root).as_posix()

    def add(self, paths: list[str] | None = None, force: bool = False, dry_run: bool = False, validate: bool = True, compress: bool | None = None) -> DataFrame:
        """(path, status, blob_hash, file_type, size_bytes): added, updated or ignored for each file found.

        A dry run stages nothing. Validators look at the directories of the
        files; a failed one stops the staging. The tree is read once: blobs,
        index, validators and report all come from the same stored scan.
        Large blobs are stored in gzip, all with ``compress`` True.
        """
        self._state()
        wanted = [self._inside(p) for p in paths or ["."]]
        found = worktree.scan(self.spark, self.root)
        if "." not in wanted:
            inside = F.lit(False)
            for p in wanted:
                inside = inside | (F.col("path") == p) | F.col("path").startswith(p + "/")
            found = found.where(inside)
        return self._add(found, force, dry_run, validate, compress)

    def _add(self, found: DataFrame, force: bool, dry_run: bool, validate: bool, compress: bool | None = None) -> DataFrame:
        version, state = self._read()
        ignored = None if force else S.ignored(F.col("path"), worktree.patterns(self._tree))
        index = self.staged(state)
        plan = staging.staging_plan(staging.with_types(blobs.hashed(found)), index, ignored)
        at = f"{self._at}/scans/{Manifest.folder()}"
        plan.write.parquet(at)
        rows = self.spark.read.schema(plan.schema).parquet(at)
        if validate:
            texts = rows.where("status <> 'ignored'").select("path", F.col("content").cast("string").alias("text"))
            bad = self.manager().run(texts, isolate=True).where("not passed").limit(SHOWN).collect()
            if bad:
                raise StagingError("; ".join(f"{r['dir'] or '.'}: {r['rule']}: {'; '.join(r['errors'])}" for r in bad))
        report = rows.select("path", "status", "blob_hash", "file_type", "size_bytes")
        if dry_run:
            return report
        taken = rows.where("status <> 'ignored'")
        store = self.blob_store(state)
        store.write(taken.select("blob_hash", "content"), compress)
        state = state | {"tables": state["tables"] | {"blobs": store.entries}}
        self._stage(version, state, snapshots.overlay(index, taken.select("path", "blob_hash", "size_bytes", "mtime", "file_type")))
        return report

    def remove(self, paths: list[str]) -> dict[str, list[str]]:
        """Take paths out of the index: which were removed, and which were not in it."""
        version, state = self._read()
        index, asked = self.staged(state), self.spark.createDataFrame([(p,) for p in paths], "path string")
        known = {r["path"] for r in index.join(F.broadcast(asked.distinct()), "path", "left_semi").select("path").collect()}  # no more than were given
        if known:
            self._stage(version, state, staging.unstaged(index, asked))
        return {"removed": [p for p in paths if p in known], "not_staged": [p for p in paths if p not in known]}

    def clear(self) -> None:
        version, state = self._read()
        self._stage(version, state, None)

    # commits

    def resolve(self, rev: str = "HEAD") -> str:
        """The full hash of ``HEAD``, ``HEAD~n``, a hash or a prefix that only one commit has."""
        head = re.fullmatch(r"HEAD(?:~(\d*))?", rev)
        if head:
            at, back = self._state()["head"], 0 if head[1] is None else int(head[1] or 1)
            if at is None:
                raise RepositoryError("there is no commit yet")
            if back:
                start = self.commits().where(F.col("commit_hash") == at)
                got = snapshots.ancestors(self.commits(), ["commit_hash"], ["parent_hash"], start).where(F.col("depth") == back).first()
                if got is None:
                    raise RepositoryError(f"{rev} does not exist")
                at = got["commit_hash"]
            return at
        try:
            found = [r["commit_hash"] for r in snapshots.by_prefix(self.commits(), rev).select("commit_hash").limit(2).collect()]
        except ValueError as e:
            raise RepositoryError(str(e)) from None
        if len(found) != 1:
            raise RepositoryError(f"{rev} names no commit" if not found else f"{rev} is ambiguous")
        return found[0]

    def snapshot(self, rev: str = "HEAD") -> DataFrame:
        return commits.snapshot_files(self.commits().where(F.col("commit_hash") == self.resolve(rev))).drop("commit_hash")

    def commit(self, message: str, author: str | None = None, all_tracked: bool = False, allow_empty: bool = False, timestamp: str | None = None) -> str:
        """Make what is staged a commit, and give its hash.

        Diffs, outputs and the commit itself are written first and become
        visible by one version together with the new head; a writer that
        fails before leaves nothing that anyone sees.
        """
        self.manager()
        if all_tracked and self._state()["head"]:
            tracked = worktree.scan(self.spark, self.root).join(self.snapshot().select("path"), "path", "left_semi")
            self._add(tracked, force=True, dry_run=False, validate=False)
        version, state = self._read()
        head = state["head"]
        parent = self.snapshot(head) if head else None
        staged = self.staged(state)
        if staged.isEmpty() and not allow_empty:
            raise RepositoryError("nothing is staged")
        fresh = staged.select("path", "blob_hash", "file_type", F.lit(False).alias("is_reference"), "size_bytes")
        whole = fresh if parent is None else snapshots.overlay(parent.select(*fresh.columns), fresh)
        record = whole.agg(F.array_sort(F.collect_list(F.struct("path", "blob_hash", "file_type", "is_reference", "size_bytes"))).alias("files"))
        record = record.select(
            F.lit(head).cast("string").alias("parent_hash"), F.lit(timestamp or datetime.now(timezone.utc).isoformat()).alias("timestamp"), F.lit(author or f"{getpass.getuser()}@{platform.node()}").alias("author"), F.lit(message).alias("message"),
            F.create_map(F.lit("hostname"), F.lit(platform.node()), F.lit("python"), F.lit(platform.python_version())).alias("environment"),
            F.transform("files", lambda f: F.struct(f["blob_hash"].alias("blob_hash"), f["file_type"].alias("file_type"), f["is_reference"].alias("is_reference"), f["path"].alias("path"), f["size_bytes"].alias("size_bytes"))).alias("files"),
        )
        row = commits.with_hash(record).persist()
        try:
            name = row.first()["commit_hash"]
            if not self.table("commits", schemas.COMMITS, state).where(F.col("commit_hash") == name).isEmpty():
                raise RepositoryError(f"{name} exists already")
            tables = dict(state["tables"])
            if parent is not None and not staged.isEmpty():
                changes = self._semantic(fresh, parent, state=state).select(F.lit(name).alias("commit_hash"), "*")
                tables["diffs"] = self._appended(state, "diffs", schemas.DIFFS, changes)
            tables["outputs"] = self._appended(state, "outputs", schemas.OUTPUT, self._outputs(name, fresh, state))
            tables["commits"] = self._appended(state, "commits", schemas.COMMITS, row)
        finally:
            row.unpersist()
        self._versions.publish(version, state | {"head": name, "staged": None, "tables": tables})
        return name

    def _outputs(self, name: str, fresh: DataFrame, state: dict) -> DataFrame:
        """One row of what the outputs of a commit say; none without outputs."""
        typed = fresh.select("path", "blob_hash", S.type_at_diff(F.col("path")).alias("file_type")).where(F.col("file_type").isin(*commits.OUTPUTS))
        texts = typed.join(self._texts(typed.select("blob_hash"), state), "blob_hash")
        return commits.output_summary(registry.facts_of(texts, list(commits.OUTPUTS)), typed.select(F.lit(name).alias("commit_hash"), "blob_hash", "file_type"))

    def outputs(self) -> DataFrame:
        """Output summaries of all commits that staged an output."""
        return self.table("outputs", schemas.OUTPUT)

    def diffs(self) -> DataFrame:
        """Semantic entries recorded when commits were made."""
        return self.table("diffs", schemas.DIFFS)

    def file_summaries(self, rev: str = "HEAD") -> DataFrame:
        """Counts of a commit's semantic entries by file."""
        return facts.summarize(self.diffs().where(F.col("commit_hash") == self.resolve(rev)), ["commit_hash", "file"])

    def commit_exists(self, commit_hash: str) -> bool:
        """Whether there is a commit of this full hash; a malformed one is not there."""
        return not commits.existing(self.spark.createDataFrame([(commit_hash,)], "commit_hash string"), self.commits()).isEmpty()

    def log(self, max_count: int | None = None, start: str | None = None) -> DataFrame:
        history = self.commits().select("commit_hash", "parent_hash", "timestamp", "author", "message")
        return snapshots.page_from(history, start, max_count) if start else snapshots.history(history, max_count)

    # diff, status, reproduce

    def _texts(self, hashes: DataFrame, state: dict | None = None, extra: DataFrame | None = None) -> DataFrame:
        """(blob_hash, text) of these hashes, from the parts of the store that can hold them, and from ``extra`` (blob_hash, content)."""
        found = self.blob_store(state).find(hashes).select("blob_hash", F.col("content").cast("string").alias("text"))
        if extra is None:
            return found
        own = extra.join(hashes.select("blob_hash").distinct(), "blob_hash", "left_semi").select("blob_hash", F.col("content").cast("string").alias("text"))
        return found.unionByName(own).dropDuplicates(["blob_hash"])

    def _semantic(self, new: DataFrame, old: DataFrame, extra: DataFrame | None = None, how: str = "inner", state: dict | None = None) -> DataFrame:
        """Entries for files that both snapshots have (or one, with a full outer join); equal contents are neither fetched nor parsed."""
        pairs = snapshots.version_pairs(new, old, how).withColumn("file_type", registry.type_of(F.col("file"))).where(F.col("file_type").isin(*registry.PARSERS))
        types = [r["file_type"] for r in pairs.select("file_type").distinct().collect()]  # at most one for each parser
        version = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_hash").alias("blob_hash"))
        sides = pairs.select("file", "file_type", F.inline(F.array(version("new"), version("old")))).where("blob_hash is not null")
        return diff.diff_sides(sides, self._texts(sides.select("blob_hash"), state, extra), types)

    def _sides(self, rev1: str | None, rev2: str | None, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """New and old snapshot; without a second revision the new one is the working tree, as far as it is tracked or ``path``."""
        if rev2 is not None:
            return self.snapshot(rev1 or "HEAD"), self.snapshot(rev2), None
        old = self.snapshot(rev1 or "HEAD")
        tracked = old.select("path") if path is None else old.select("path").unionByName(self.spark.createDataFrame([(path,)], "path string"))
        disk = blobs.hashed(worktree.scan(self.spark, self.root)).join(tracked, "path", "left_semi")
        return disk, old, disk

    def diff(self, rev1: str | None = None, rev2: str | None = None, path: str | None = None) -> DataFrame:
        """Semantic entries between rev1 (new) and rev2 (old), or the working tree and rev1.

        A ``path`` that only the working tree has is compared with nothing:
        all its facts are added.
        """
        new, old, disk = self._sides(rev1, rev2, path)
        if path is not None:
            new, old = new.where(F.col("path") == path), old.where(F.col("path") == path)
            if new.isEmpty() and old.isEmpty():
                raise RepositoryError(f"{path} is in neither side")
            return self._semantic(new, old, disk, "full_outer")
        return self._semantic(new, old, disk)

    def unified(self, rev1: str | None = None, rev2: str | None = None, path: str | None = None, context: int = 3) -> DataFrame:
        """(file, text): unified text differences of changed files, in UTF-8; other bytes are shown as replaced."""
        new, old, disk = self._sides(rev1, rev2, path)
        if path is not None:
            new, old = new.where(F.col("path") == path), old.where(F.col("path") == path)
        pairs = snapshots.version_pairs(new, old, "full_outer")
        hashes = pairs.select(F.explode(F.array("new_hash", "old_hash")).alias("blob_hash")).where("blob_hash is not null")
        texts = self._texts(hashes, None, disk)
        for side in ("new", "old"):
            pairs = pairs.join(texts.select(F.col("blob_hash").alias(f"{side}_hash"), F.col("text").alias(f"{side}_text")), f"{side}_hash", "left")
        return diff.unified(pairs, context)

    def changed_files(self, rev1: str | None = None, rev2: str | None = None) -> DataFrame:
        """(path, change): added, deleted or modified; modified files without a semantic entry are marked cosmetic."""
        new, old, disk = self._sides(rev1, rev2)
        changed = snapshots.compare(new.select("path", "blob_hash"), old.select("path", "blob_hash")).select("path", "change")
        return diff.mark_cosmetic(changed, self._semantic(new, old, disk))

    def status(self) -> DataFrame:
        """(path, mark, file_type, size): A for new and M for changed staged files, in order of path."""
        staged = self.staged()
        old = self.snapshot() if self._state()["head"] else self.spark.createDataFrame([], "path string, blob_hash string")
        return snapshots.marked(staged, old).orderBy("path")

    def reproduce(self, rev: str, output: str, verify: bool = True) -> DataFrame:
        """Write a snapshot's files to a folder on any file system, and compare what was written.

        (path, status, error): ok, mismatch, missing (no such blob) or failed
        (with the reason) for each file. Without ``verify`` the files are not
        read again, and one that could be written is ``written``.
        """
        wanted = self.snapshot(rev)
        found = self.blob_store().find(wanted.select("blob_hash"))
        rows = wanted.select("path", "blob_hash").join(found, "blob_hash", "left").select("path", "content")
        report = f"{self.store}/reports/{Manifest.folder()}"
        written = tree.write(rows, output, report).dropDuplicates(["path"])
        if not verify:
            return written
        actual = blobs.hashed(tree.read(self.spark, output)).select("path", F.col("blob_hash").alias("actual_hash"))
        told = blobs.audit(wanted.select("path", "blob_hash"), actual).select("path", F.col("status").alias("found"))
        status = F.when(F.col("status") == "written", F.col("found")).otherwise(F.coalesce("status", F.lit("missing")))
        return told.join(written, "path", "left").select("path", status.alias("status"), "error")

    def environment(self, rev: str) -> DataFrame:
        row = self.commits().where(F.col("commit_hash") == self.resolve(rev))
        return commits.compare_environment(row, {"hostname": platform.node(), "python": sys.version.split()[0]})

    # validators

    def validators(self) -> list[dict]:
        self._state()
        return self.manager().list()

    def set_validator(self, name: str, enabled: bool) -> None:
        try:
            self.manager().set_enabled(name, enabled)
        except KeyError:
            raise RepositoryError(f"no validator is called {name}") from None
