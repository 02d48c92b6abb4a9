"""A CSV sink whose runs appear whole or not at all, and once.

Tasks write their parts to a folder that readers of the table do not see; the
driver gives it its final name, ``run=<name>``, in one rename. A failed run leaves
nothing, and one that is repeated under its name adds nothing. Parts of attempts
that did not count are deleted before the rename.
"""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class RunWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.run = options.get("run") or uuid.uuid4().hex
        if not self.run.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a name of a run: {self.run}")
        self.passing = f"_passing-{uuid.uuid4().hex}"

    def _at(self, *names: str):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        return store, "/".join((folder, *names))

    def write(self, iterator):
        name = f"part-{uuid.uuid4().hex}.csv"
        store, folder = self._at(self.passing)
        store.create_dir(folder, recursive=True)
        n = 0
        with store.open_output_stream(f"{folder}/{name}") as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as out:
            rows = csv.writer(out)
            rows.writerow(self.columns)
            for row in iterator:
                rows.writerow(["" if x is None else x for x in row])
                n += 1
        return Part(name, n)

    def commit(self, messages) -> None:
        store, folder = self._at(self.passing)
        _, final = self._at(f"run={self.run}")
        counted = {m.name for m in messages if m and m.rows}
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name not in counted:
                store.delete_file(info.path)
        if not counted or store.get_file_info(final).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        store.move(folder, final)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, folder = self._at(self.passing)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class RunSink(DataSource):
    """df.write.format("jobruns").mode("append").option("path", folder).option("run", name).save()"""

    @classmethod
    def name(cls):
        return "jobruns"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("runs are only added")
        return RunWriter(self.options, schema.names)


def add_run(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Add the rows to the CSV table at ``path`` (a URI) as one run; a run of that name that is there already stays as it is."""
    rows.sparkSession.dataSource.register(RunSink)
    writer = rows.write.format("jobruns").mode("append").option("path", path)
    (writer.option("run", run) if run else writer).save()
