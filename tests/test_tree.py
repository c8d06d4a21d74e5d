"""The source-tree data source: what it lists, what it opens, and what filters reach it."""

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.operators import recon
from siftlake.sources import tree

FILES = {
    "src/a.ts": "one\ntwo", "src/b.TS": "", "src/deep/er/c.py": "import x\n", "src/deep/notes.txt": "not code", "Dockerfile": "FROM x", "src/.hidden": "x", "lib/d.js": "d" * 5000,
    "src/node_modules/e.ts": "x", "dist/f.ts": "x", "lib/build": "a file of that name", "lib/.git/g.js": "x", "with+plus (1)/h.ts": "h", "empty/.cache/i.ts": "x",
}
SEEN = {p for p in FILES if not set(p.split("/")) & set(dims.EXCLUDED_NAMES)}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("a+b (tree).d")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    (top / "nothing").mkdir()
    return str(top)


class Counting:
    """A file system that counts what is listed and opened."""

    def __init__(self):
        self.local, self.listed, self.opened = fs.LocalFileSystem(), [], []

    def get_file_info(self, selector):
        self.listed.append(selector.base_dir)
        return self.local.get_file_info(selector)

    def open_input_stream(self, path):
        self.opened.append(path)
        return self.local.open_input_stream(path)


def walked(root, filters=(), content=True, **options):
    """Paths, and what was listed and opened, of a reader in this process."""
    reader = tree.TreeReader({"path": root, **options}, content)
    left, counted = list(reader.pushFilters(list(filters))), Counting()
    reader.system = lambda: (counted, root)
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    return rows, counted, left


def test_excluded_folders_are_never_listed_and_files_opened_once(root):
    for folders in ("1", "3", "256"):
        rows, counted, _ = walked(root, folders=folders)
        assert sorted(r["path"] for r in rows) == sorted(SEEN)
        assert all(r["content"] == FILES[r["path"]].encode() and r["bytes"] == len(FILES[r["path"]]) for r in rows)
        assert sorted(counted.opened) == sorted(f"{root}/{p}" for p in SEEN)
        assert not any(name in path.removeprefix(root).split("/") for path in counted.listed for name in dims.EXCLUDED_NAMES)


def test_no_file_is_opened_without_content(root):
    rows, counted, _ = walked(root, content=False)
    assert len(rows) == len(SEEN) and not counted.opened


def test_filters_prune_folders_and_files(root):
    D = tree.D
    rows, counted, left = walked(root, [D.StringStartsWith(("path",), "src/deep/"), D.In(("ext",), (".py", ".ts")), D.IsNotNull(("ext",))])
    assert [r["path"] for r in rows] == ["src/deep/er/c.py"] and not left and counted.opened == [f"{root}/src/deep/er/c.py"]
    assert not any("lib" in p or "plus" in p for p in (x.removeprefix(root) for x in counted.listed))
    rows, counted, left = walked(root, [D.GreaterThan(("bytes",), 100), D.Not(D.EqualTo(("name",), "a.ts")), D.EqualTo(("modified",), 1)])
    assert [r["path"] for r in rows] == ["lib/d.js"] and len(left) == 1 and len(counted.opened) == 1


def test_read_with_spark(spark, root):
    found = tree.read(spark, root).where(F.col("path").startswith("src/") & F.col("ext").isin(".ts", ".py"))
    assert sorted(r["path"] for r in found.collect()) == ["src/a.ts", "src/b.TS", "src/deep/er/c.py"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], plan
    assert tree.read(spark, root + "/nothing").count() == 0
    assert tree.read(spark, f"file://{root}".replace(" ", "%20"), content=True).where("ext = '.dockerfile'").first()["content"] == b"FROM x"


def test_scan_tree(spark, root):
    got = {r["path"]: (r["language"], r["content"]) for r in recon.scan_tree(spark, root).collect()}
    assert got == {p: (lang, FILES[p]) for p, lang in {"src/a.ts": "typescript", "src/b.TS": "typescript", "src/deep/er/c.py": "python", "Dockerfile": "docker", "lib/d.js": "javascript", "with+plus (1)/h.ts": "typescript"}.items()}
    assert "content" not in recon.scan_tree(spark, root, content=False).columns


def test_write_and_read_back(spark, tmp_path):
    files = spark.createDataFrame([(f"d{i % 7}/{i}.ts", f"text {i}") for i in range(200)], "path string, content string").repartition(4)
    assert tree.write(files, str(tmp_path / "t")) == 200
    back = recon.scan_tree(spark, str(tmp_path / "t")).select("path", "content")
    assert back.exceptAll(files).count() == 0 and back.count() == 200
