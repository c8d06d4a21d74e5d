"""Trees of many folders: no more tasks than folders are to be shared by, and deleted by tasks."""

from siftlake.sources import tree


def many(top):
    for i in range(300):
        (top / f"src/n{i}/deep").mkdir(parents=True)
        (top / f"src/n{i}/deep/{i}.ts").write_text("x")
        (top / f"src/n{i}/{i}.js").write_text("y")
    (top / "a.py").write_text("z")


def test_folders_are_shared_by_few_tasks(tmp_path):
    many(tmp_path)
    for folders in (1, 7, 64):
        reader = tree.TreeReader({"path": str(tmp_path), "folders": str(folders)})
        shares = reader.partitions()
        assert 0 < len(shares) <= folders
        found = [path for share in shares for batch in reader.read(share) for path in batch.column("path").to_pylist()]
        assert len(found) == len(set(found)) == 601


def test_tasks_delete_a_tree(spark, tmp_path, monkeypatch):
    top, left = tmp_path / "t", []
    many(top)
    (top / "node_modules/x").mkdir(parents=True)
    (top / "node_modules/x/y.ts").write_text("")
    monkeypatch.setattr(tree, "removed", lambda spark, root: left.extend(p for p in top.rglob("*") if p.is_file()))
    tree.remove(spark, str(top))
    assert not left
    monkeypatch.undo()
    tree.remove(spark, str(top))
    assert not top.exists()
