import os

import pytest
from pyspark.sql import functions as F

from functools import partial

from tarnfold import config
from tarnfold.functions import paths
from tarnfold.operators import fulltext
from tarnfold.errors import FileNotIndexed, PathNotFound, UnsupportedFileType
from tarnfold.service import Index, index_all
from tarnfold.sources import scan as source
from tarnfold.streaming.watch import stream_postings


Config = partial(config.Config, embedding_model="hash-384")


def write(folder, name, data=b"text"):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data if isinstance(data, bytes) else data.encode())
    return os.path.realpath(at)


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "docs"
    write(d, "python.txt", "Python is a programming language. " * 60)
    write(d, "rust.md", "Rust is a systems language")
    write(d, "empty.txt", b"")
    write(d, "_name.txt", "under")
    write(d, "crlf.txt", b"a\r\nb\xff")
    write(d, "sp ace%_.txt", "odd name")
    write(d, "skip.iso", "x")
    write(d, ".hidden/x.txt", "x")
    write(d, "photo.jpg", "x")
    write(d, "broken.docx", "no zip")
    write(tmp_path / "docs2", "other.txt", "sibling words")
    return d


def test_scan(spark, tree):
    found = [os.path.basename(r.path) for r in source.scan(source.listing(spark, str(tree)), Config(), str(tree)).collect()]
    assert found == sorted(["_name.txt", "broken.docx", "crlf.txt", "empty.txt", "python.txt", "rust.md", "sp ace%_.txt"])
    assert source.listing(spark, str(tree / "none")).count() == 0


def test_life_of_an_index(spark, tree, tmp_path):
    index = Index(spark, Config(root=str(tmp_path / "index"), workers=2))
    with pytest.raises(PathNotFound):
        index.index(str(tmp_path / "none"))
    r = index.index(str(tree))
    assert (r["files_indexed"], r["files_skipped"], r["files_errored"]) == (6, 0, 1)
    q = index.quality()
    assert (q["total"], q["unresolved"], q["by_type"]) == (1, 1, {"permanent": 1})
    again = index.index(str(tree))
    assert (again["files_indexed"], again["files_skipped"], again["files_errored"]) == (0, 6, 1)
    write(tree, "rust.md", "Rust changed its words")
    assert index.index(str(tree))["files_indexed"] == 1
    assert [r.content for r in index.get_chunks(os.path.realpath(tree / "rust.md")).collect()] == ["Rust changed its words"]
    assert [r.content for r in index.get_chunks(os.path.realpath(tree / "crlf.txt")).collect()] == ["a\nb�"]
    assert index.get_chunks(os.path.realpath(tree / "empty.txt")).collect() == []
    hits = index.search("rust changed", limit=3).collect()
    assert hits[0].path.endswith("rust.md") and hits[0].source == "vector"
    assert all(not r.path.endswith("python.txt") for r in index.similar(os.path.realpath(tree / "python.txt")).collect())
    with pytest.raises(FileNotIndexed):
        index.similar("/none")
    s = index.status().head()
    assert s.total_files == 6 and s.last_run.status == "completed"
    index.index(str(tree.parent / "docs2"))
    assert index.list_files(str(tree)).count() == 7
    assert [r.path.rsplit("/", 1)[1] for r in index.list_files(limit=1).collect()] == ["other.txt"]
    assert index.log(2).count() == 2
    os.remove(tree / "_name.txt")
    back = index.reindex()
    assert back["files_removed"] == 1 and back["files_indexed"] == 6
    left = {(r.token, r.chunk_id) for r in index.store.read("postings").collect()}
    chunks = index.store.read("chunks")
    assert left == {(r.token, r.id) for r in fulltext.postings(chunks, "id", "content").collect()}
    s = index.store.read("corpus").groupBy().sum("n", "tokens").head()
    assert tuple(s) == tuple(fulltext.corpus(chunks, "content").head())
    assert index.remove("/none") == {"path": "/none", "files_removed": 0}
    assert index.remove(str(tree))["files_removed"] == 5
    assert [r.path.rsplit("/", 1)[1] for r in index.list_files().collect()] == ["other.txt"]
    assert index.store.read("vectors").count() == index.store.read("chunks").count() == 1


def test_single_files(spark, tree, tmp_path):
    index = Index(spark, Config(root=str(tmp_path / "index"), workers=1))
    assert index.index(str(tree / ".hidden/x.txt"))["files_indexed"] == 1
    with pytest.raises(UnsupportedFileType):
        index.index(str(tree / "skip.iso"))
    lines = index_all(spark, Config(root=str(tmp_path / "index2"), paths=(str(tree.parent / "docs2"), "/none")))
    assert "1 indexed" in lines[0] and "not a directory" in lines[1]


def test_stream_of_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 0, "red fox", None), (2, 1, 1, "red red", None)], "id long, file_id long, chunk_index int, content string, metadata string")
    chunks.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_postings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    got = {(r.token, r.id): r.tf for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("red", 1): 1, ("fox", 1): 1, ("red", 2): 2}


def test_runs_batches_and_missing_files(spark, tree, tmp_path, monkeypatch):
    index = Index(spark, Config(root=str(tmp_path / "index"), workers=1, batch=2))
    first = index.index(str(tree), batch_limit=2)
    assert first["files_found"] == 2 and [os.path.basename(r["path"]) for r in first["details"]] == ["_name.txt", "broken.docx"]
    with pytest.raises(ValueError):
        index.index(str(tree), batch_limit=-1)
    import zipfile

    with zipfile.ZipFile(tree / "broken.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First words</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>last</w:t></w:r></w:p></w:body></w:document>')
    whole = index.index(str(tree))
    assert whole["errors_resolved"] == 1 and whole["files_indexed"] == 6 and whole["files_skipped"] == 1
    assert [r.content for r in index.get_chunks(os.path.realpath(tree / "broken.docx")).collect()] == ["First words\n\nlast"]
    states = [(r.id, r.seq, r.status, r.files_skipped) for r in index.store.read("runs").orderBy("id", "seq").collect()]
    assert states[0][2] == "running" and (2, 2, "running", 1) in states and states[-1][2] == "completed"
    for name in ("rust.md", "python.txt", "empty.txt"):
        os.remove(tree / name)
    commits = []
    monkeypatch.setattr(index.store, "commit", lambda add=None, **tables: commits.append((sorted(add or {}), sorted(tables))) or type(index.store).commit(index.store, add, **tables))
    back = index.reindex()
    assert back["files_removed"] == 3 and sum("files" in tables for _, tables in commits) == 1
    assert {os.path.basename(r.path) for r in index.list_files().collect()} == {"_name.txt", "broken.docx", "crlf.txt", "sp ace%_.txt"}
    write(tree, "new.txt", "new words")
    commits.clear()
    assert index.index(str(tree))["files_indexed"] == 1 and all(not tables for _, tables in commits)
    assert [r.path.rsplit("/", 1)[1] for r in index.search("new words", limit=1).collect()] == ["new.txt"]
    broken = Index(spark, Config(root=str(tmp_path / "index"), workers=1, embedding_model="none"))
    write(tree, "more.txt", "more words")
    before = index.list_files().count()
    with pytest.raises(Exception):
        broken.index(str(tree))
    run = index.log(1).head()
    assert run.status == "failed" and run.error_message and run.files_found == 6 and index.list_files().count() == before


def test_deep_trees_and_suffixes(spark, tmp_path):
    for k in range(80):
        write(tmp_path / "t", f"d{k}/e/{'x' if k % 2 else 'y'}.txt", "x")
    assert source.listing(spark, str(tmp_path / "t")).count() == 80
    text = ".txt .md .markdown .rst .csv .tsv .json .yaml .yml .toml .ini .cfg .py .js .ts .go .rs .java .c .cpp .h .sh .bash .zsh .fish .html .htm .xml .svg .sql .r .rb .pl .lua .tex .bib .org .log .conf .env".split()
    assert len(text) == 40 and set(paths.supported(False)) == {*text, ".pdf", ".docx"}
    kinds = spark.createDataFrame([(f"/a/b{s}",) for s in text], "p string").select(paths.file_type(F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["markdown" if s in (".md", ".markdown") else "text" for s in text]
