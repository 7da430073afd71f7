import math
import random

import pytest
from pyspark.sql import functions as F

from tarnfold import config, params
from tarnfold.errors import classify_error
from tarnfold.functions import exif, paths, text
from tarnfold.sources import vision


def plain_windows(t, size, overlap):
    out, at, step = [], 0, size - overlap
    if not t or not t.strip():
        return []
    while True:
        piece = t[at : at + size]
        if piece.strip():
            out.append(piece)
        if at + size >= len(t):
            return out
        at += step


def test_windows_equal_a_plain_version(spark):
    r = random.Random(3)
    texts = ["", " \n ", "A" * 250, "ABCDEFGHIJ" * 10, "short"] + ["".join(r.choice("ab é🗂️\n\x1c") for _ in range(r.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for size, overlap in ((100, 20), (40, 10), (7, 0)):
        got = {x[0]: x[1] for x in df.select("id", text.windows(F.col("t"), size, overlap)).collect()}
        assert got == {i: plain_windows(t, size, overlap) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        text.windows(F.col("t"), 10, 10)


def test_decoding_and_tokens(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc\xff"),), (None,)], "b binary")
    assert [r[0] for r in df.select(text.decoded(F.col("b"))).collect()] == ["a\nb\nc�", None]
    words = spark.createDataFrame([("Café under_score it's 東京 x2 ½",)], "t string").select(text.tokens(F.col("t"))).head()[0]
    assert words == ["cafe", "under", "score", "it", "s", "東京", "x2", "½"]


def test_file_types_and_patterns(spark):
    names = ["/a/x.PDF", "/a/y.md", "/a/z.tar.gz", "/a/.env", "/a/Makefile", "/a/b.iso", "/a/v.mp4", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select(paths.file_type(F.col("p")), paths.suffix(F.col("p")), paths.base_name(F.col("p")).rlike(paths.glob_regex(config.EXCLUDED))).collect()
    assert [r[0] for r in got] == ["pdf", "markdown", None, None, None, None, "video", None]
    assert [r[1] for r in got][:4] == [".pdf", ".md", ".gz", ""]
    assert [r[2] for r in got] == [False, False, True, False, False, True, False, None]
    assert ".jpg" in paths.supported(True) and ".jpg" not in paths.supported(False)


def test_prefixes(spark):
    df = spark.createDataFrame([("/docs/a",), ("/docs2/a",), ("/DOCS/É",), ("/dXcs/a",)], "p string")
    pick = lambda *a, **k: [r[0] for r in df.where(paths.has_prefix(F.col("p"), *a, **k)).collect()]
    assert pick("/docs") == ["/docs/a", "/docs2/a", "/DOCS/É"]
    assert pick("/d_cs") == ["/docs/a", "/docs2/a", "/DOCS/É", "/dXcs/a"]
    assert pick("/docs", compat=False) == ["/docs/a", "/docs2/a"]
    assert pick("/docs", boundary=True) == ["/docs/a", "/DOCS/É"]
    assert len(pick("")) == len(pick(None)) == 4
    assert pick("/docs/é") == []


def test_errors(spark):
    df = spark.createDataFrame([("Read TIMEOUT",), ("HTTP 503",), ("bad zip",), (None,)], "m string")
    assert [r[0] for r in df.select(classify_error(F.col("m"))).collect()] == ["transient", "transient", "permanent", "permanent"]


def test_exif():
    assert math.isclose(exif.degrees((50, 50, 48)), 50.8467, abs_tol=1e-3)
    gps = {"GPSLatitude": (50, 50, 48), "GPSLatitudeRef": "S", "GPSLongitude": ((10, 1), 0, 0), "GPSLongitudeRef": "E"}
    assert exif.exif_text({306: "c", 36868: "b", 271: "Maker", 272: "Maker X"}, gps, (3, 4)) == "[EXIF] Date: b | Camera: Maker X | GPS: -50.8467°N, 10.0000°E | Size: 3x4"
    assert exif.exif_text({}) == "" and exif.gps_text({"GPSLatitude": (1, 2, 3)}) == ""


def test_config_and_params():
    c = config.from_env({"TARNFOLD_PATHS": "/a: :/b", "TARNFOLD_EXCLUDE_PATTERNS": "*.x, *.y", "TARNFOLD_VISION_BACKEND": "OpenAI"})
    assert c.paths == ("/a", "/b") and c.excluded == ("*.x", "*.y") and c.caption_model == "gpt-4o-mini"
    with pytest.raises(ValueError):
        config.Config(chunk_size=10, chunk_overlap=10)
    params.Search("x", None, 100), params.Listing(offset=0), params.Chunks("p", 500)
    for bad in (lambda: params.Search(""), lambda: params.Search("x" * 2001), lambda: params.Search("x", limit=0), lambda: params.Search("x", limit=101), lambda: params.Similar("a", True), lambda: params.Listing(limit=501), lambda: params.Listing(offset=-1), lambda: params.OnePath("p" * 4097)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        params.OnePath("p", extra=1)


def test_vision(tmp_path):
    assert vision.mime("a.JPG") == "image/jpeg"
    with pytest.raises(vision.ExtractionFailed):
        vision.mime("a.txt")
    assert vision.backend(config.Config()) is None
    with pytest.warns(UserWarning):
        assert vision.backend(config.Config(vision_backend="other")) is None
    b = vision.backend(config.Config(vision_backend="openai"))
    with pytest.raises(vision.ExtractionFailed):
        b.caption("v.mp4", b"", "video")
    b.ask = lambda *a: "  "
    with pytest.raises(vision.ExtractionFailed, match="empty"):
        b.caption("a.png", b"", "image")
    b.ask = lambda *a: " a cat "
    assert b.caption("a.png", b"", "image") == "a cat"
