"""The four verbs: store, read, list and delete files, on tables in one folder."""

from __future__ import annotations

import argparse
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.formatting import catalog_key
from strandlake.operators import catalog
from strandlake.runtime import written
from strandlake.sources import files as fs


class Store:
    """Files as chunks kept once. Tables: ``files`` (catalog), ``recipes`` (chunks of each content in order), ``chunks`` (bytes by fingerprint).

    A file's key is its name, client and inode, so that files of one name in several folders are several files. Contents are read in byte
    ranges and never are one row or one value. Every write adds Parquet files of a new version, which is a time and a random part, so
    that two writers never have the same; a file is there once its catalog row is, and that is written last. A later version of a key
    replaces the earlier one; a delete is a row with ``deleted``.
    """

    def __init__(self, spark: SparkSession, root: str, chunk: int = 8192, split: int = fs.SPLIT):
        self.spark, self.root, self.chunk, self.split = spark, root.rstrip("/"), chunk, split

    _SCHEMAS = {
        "files": "file_key string, name string, client_id int, inode bigint, filetype int, filesize bigint, mtime timestamp, md5 string, version bigint, writer string, deleted boolean",
        "recipes": "md5 string, file_offset bigint, chunk_size int, sha string",
        "chunks": "sha string, data binary",
    }

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(path)

    def files(self) -> DataFrame:
        """The catalog: the last version of each key that is not deleted."""
        return catalog.latest(self.table("files"), ["file_key"], ["version", "writer"]).where("not deleted")

    def _commit(self, rows: DataFrame, deleted: bool) -> None:
        marked = rows.withColumns({"version": F.lit(time.time_ns()).cast("bigint"), "writer": F.lit(uuid.uuid4().hex), "deleted": F.lit(deleted)})
        marked.select(*self.table("files").columns).write.mode("append").parquet(f"{self.root}/files")

    def store(self, path: str | list[str], filetype: int | None = None, client: int = 0) -> int:
        """Store all files under one or several paths: only contents, and of these only chunks, that are not there yet are written. The number of files."""
        new = fs.listed(self.spark, path)
        if filetype is not None:
            new = new.withColumn("filetype", F.lit(filetype))
        new = written(new.join(fs.file_md5(new), "uri"), "listed")
        one = new.groupBy("md5").agg(F.min_by(F.struct("uri", "filesize"), "uri").alias("f")).join(self.table("recipes").select("md5").distinct(), "md5", "left_anti")
        fresh = written(one.select("md5", "f.uri", "f.filesize"), "fresh")
        cut = written(fs.file_chunks(fresh, self.chunk, self.split), "cut")
        unique = cut.groupBy("sha").agg(F.first("data").alias("data")).join(self.table("chunks").select("sha"), "sha", "left_anti")
        unique.write.mode("append").parquet(f"{self.root}/chunks")
        cut.join(fresh.select("uri", "md5"), "uri").select("md5", "file_offset", "chunk_size", "sha").write.mode("append").parquet(f"{self.root}/recipes")
        keyed = new.withColumns({"client_id": F.lit(client), "file_key": catalog_key("name", F.lit(client), "inode")})
        self._commit(keyed, False)
        return new.count()

    def named(self, names: list[str], client: int | None = None) -> DataFrame:
        """The catalog rows of keys, or of names without client and inode; with client, of that client only."""
        rows = self.files().where(F.col("file_key").isin(names) | F.col("name").isin(names))
        return rows if client is None else rows.where(F.col("client_id") == client)

    def pieces(self, names: list[str], client: int | None = None) -> DataFrame:
        """file_key, name, file_offset, data: the chunks of the named files."""
        want = self.named(names, client).select("file_key", "name", "md5")
        parts = want.join(self.table("recipes").dropDuplicates(["md5", "file_offset"]), "md5")
        return parts.join(self.table("chunks").dropDuplicates(["sha"]), "sha").select("file_key", "name", "file_offset", "data")

    def read(self, names: list[str], client: int | None = None) -> DataFrame:
        """file_key, name, content of the named files, each as one value; those that are not there have no row. See read_to for large ones."""
        from strandlake.operators.recipes import reassembled

        want = self.named(names, client).select("file_key", "name")
        data = reassembled(self.pieces(names, client).select("file_key", "file_offset", "data"), "file_key", "file_offset", "data")
        return want.join(data, "file_key", "left").select("file_key", "name", F.coalesce("data", F.unhex(F.lit(""))).alias("content"))

    def read_to(self, name: str, dest: str, client: int | None = None) -> int:
        """Write the one file of a key or name to a local path, a partition of chunks at a time. Its size; KeyError where there is none or are several."""
        keys = [r["file_key"] for r in self.named([name], client).select("file_key").take(2)]
        if len(keys) != 1:
            raise KeyError(f"{name}: {'several files, give the key' if keys else 'no such file'}")
        size = 0
        with open(dest, "wb") as f:
            for r in self.pieces(keys, client).orderBy("file_offset").select("data").toLocalIterator():
                size += f.write(r["data"])
        return size

    def list(self) -> DataFrame:
        rows = self.files()
        return catalog.listing(rows).withColumnRenamed("name", "key").join(rows.select(F.col("file_key").alias("key"), "name"), "key").select("name", "key", "size", "type", "mtime").orderBy("name", "key")

    def delete(self, names: list[str], client: int | None = None) -> int:
        """Take keys or names out of the catalog. The number of files that were there."""
        gone = written(self.named(names, client), "gone")
        n = gone.count()
        if n:
            self._commit(gone, True)
        return n

    def reclaim(self) -> tuple[DataFrame, DataFrame]:
        """Recipes and chunks that no file in the catalog needs: what a vacuum may remove."""
        live = self.table("recipes").join(self.files().select("md5").distinct(), "md5", "left_semi")
        return self.table("recipes").join(live.select("md5").distinct(), "md5", "left_anti"), self.table("chunks").select("sha").join(live.select("sha").distinct(), "sha", "left_anti")


def main(argv: list[str] | None = None) -> int:
    """w PATH... [-c LIST] [-t a|q] | r NAME DEST | l | d NAME, each with --root FOLDER and, but for l, -f CLIENT. LIST is a file of paths, one a line."""
    p = argparse.ArgumentParser(prog="strandlake")
    p.add_argument("--root", required=True)
    verbs = p.add_subparsers(dest="verb", required=True)
    w = verbs.add_parser("w")
    w.add_argument("path", nargs="*")
    w.add_argument("-c", dest="conf")
    w.add_argument("-t", choices=["a", "q"])
    r = verbs.add_parser("r")
    r.add_argument("name")
    r.add_argument("dest")
    verbs.add_parser("l")
    d = verbs.add_parser("d")
    d.add_argument("name")
    for v in (w, r, d):
        v.add_argument("-f", dest="client", type=int)
    a = p.parse_args(argv)
    from strandlake.session import session

    store = Store(session(), a.root)
    if a.verb == "w":
        paths = list(a.path)
        if a.conf:
            with open(a.conf) as f:
                paths += [line.strip() for line in f if line.strip()]
        if not paths:
            p.error("no path given")
        print(store.store(paths, {"a": 100, "q": 200}.get(a.t), a.client or 0), "stored")
    elif a.verb == "r":
        try:
            store.read_to(a.name, a.dest, a.client)
        except KeyError as e:
            print(e.args[0], file=sys.stderr)
            return 1
    elif a.verb == "l":
        for x in store.list().toLocalIterator():
            print(*x, sep="\t")
    else:
        n = store.delete([a.name], a.client)
        print(n, "deleted")
        return int(n == 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
