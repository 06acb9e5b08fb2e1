import json
import os
import random
from collections import Counter

import pytest

from faultlens.operators import byteranges, triage
from faultlens.sources import corpus, documents

NAMES = {"plain": b"x", "_under": b"yy", ".dot": b"", "id:1,sig:11": b"\x00\xff", "a b%20c": b"z" * 300, "README.txt": b"no", "sub/_in/.deep": b"d", "sub/README.txt": b"no", "sub/empty": b"", "_d/f": b"ff"}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "corpus"
    for name, data in NAMES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "nothing").mkdir()
    os.symlink(root / "plain", root / "link")
    os.symlink(root, root / "loop")
    return root


def test_every_regular_file_is_listed_and_read(spark, folder):
    """Hidden, empty and odd names, links to files, folders in folders; neither README.txt nor links to folders."""
    want = {k: v for k, v in NAMES.items() if not k.endswith("README.txt")} | {"link": b"x"}
    for path in (str(folder), f"file://{folder}/", f"file:{folder}"):
        got = corpus.corpus(spark, path, recursive=True).collect()
        assert {r["path"].split("/corpus/")[1].lstrip("/"): bytes(r["content"]) for r in got} == want and len(got) == len(want)
    flat = corpus.corpus(spark, str(folder), content=False).collect()
    assert {(r["file"], r["size"]) for r in flat} == {(k, len(v)) for k, v in want.items() if "/" not in k}
    assert {r["file"] for r in corpus.corpus(spark, str(folder), recursive=True, glob="_*", content=False).collect()} == {"_under"}
    assert all(r["modified"] is not None for r in flat)


def test_folders_that_are_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound"):
        corpus.listing(spark, [f"{tmp_path}/absent"])
    assert corpus.listing(spark, [f"{tmp_path}/absent"], missing_ok=True).collect() == []
    (tmp_path / "none").mkdir()
    assert corpus.corpus(spark, f"{tmp_path}/none").collect() == []


def test_files_are_written_below_their_root(spark, tmp_path):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in NAMES.items()] + [("null", None)], "name string, content binary")
    for _ in range(2):  # once more replaces
        made = corpus.write_files(rows, f"file://{tmp_path}/out")
        assert {(r["path"].split("/out/")[1], r["size"]) for r in made.collect()} == {(k, len(v)) for k, v in NAMES.items()} | {("null", 0)}
    found = {r["path"].split("/out/")[1]: bytes(r["content"]) for r in corpus.corpus(spark, f"{tmp_path}/out", recursive=True).collect()}
    assert found == {k: v for k, v in NAMES.items() if not k.endswith("README.txt")} | {"null": b""}
    for bad in ("/abs", "a/../b", ""):
        with pytest.raises(Exception, match="not a name"):
            corpus.write_files(spark.createDataFrame([(bad, bytearray(b""))], "name string, content binary"), str(tmp_path))


def samples():
    r = random.Random(1)
    euro = "€uro naïve 😀 ".encode()
    return {
        "empty": b"", "one": b"A", "a8": b"x" * 13 + b"A" * 8 + b"y", "a7": b"A" * 7, "fmt": b"12345%n%n%n", "sled": b"\x09\x09\x09\x09\x90" + b"\x90" * 3, "nibble": b"\x19\x09\x09\x09\x0f", "euro": euro * 9,
        "cut": euro[:-2], "stray": b"abc\x80def", "over": b"ab\xe2\x82\xac\x80", "surrogate": b"\xed\xa0\x80", "long": "€".encode() * 50 + b"\xe2", "zero": b"ab\x00cd", "lines": b"a\n\nb\n",
        "random": bytes(r.randrange(256) for _ in range(500)), "four": b"\xf0\x9f\x98\x80" * 11, "late": b"\xf0\x9f\x98" + b"a" * 9, "bad4": b"a" * 6 + b"\xf8\x88\x80\x80\x80",
    }


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 7, 16, 1000])
def test_profiles_do_not_depend_on_the_ranges(spark, tmp_path, width):
    data = samples()
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r for r in byteranges.profile(corpus.listing(spark, [str(tmp_path)]), width=width, shown=width).collect()}
    assert set(got) == set(data)
    for name, raw in data.items():
        r, bad = got[name], sum(not 32 <= b <= 126 for b in raw)
        try:
            textual = bool(raw.decode() or True) and 0 not in raw
        except UnicodeDecodeError:
            textual = False
        assert (r["size"], r["nonprintable"], r["newlines"], r["textual"], r["dump"]) == (len(raw), bad, raw.count(b"\n"), textual, raw[:width].hex()), name
        assert r["pct"] == ((bad * 1000 // len(raw)) / 10 if raw else None)
        for flag, needle in byteranges.NEEDLES.items():
            assert r[f"has_{flag}"] == (needle in raw) and r[f"hex_{flag}"] == (needle.hex() in raw.hex()), (name, flag)


@pytest.mark.parametrize(("share", "kept", "most"), [(1 << 20, 4, 9), (64, 1000, 1000), (64, 8, 1000), (64, 8, 2), (8, 1, 1000), (64, 3, 1000)])
def test_top_chunks_do_not_depend_on_the_ranges(spark, tmp_path, share, kept, most):
    """Bounds that decide, candidates counted again, and files counted in full: always the chunks of whole files."""
    r = random.Random(share + kept)
    data = samples() | {f"r{k}": b"".join(r.choice([b"aaaa", b"bbbb", b"cccc", b"dddd", *(bytes([65 + i]) * 4 for i in range(k * 4))]) for _ in range(400)) + b"x" * (k % 4) for k in range(6)}
    data["skew"] = b"hot!" * 300 + b"".join(r.randbytes(4) for _ in range(200)) + b"warm" * 40 + b"cold" * 20
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    got = {}
    for x in byteranges.top_chunks(corpus.listing(spark, [str(tmp_path)]), share=share, kept=kept, most=most).collect():
        got.setdefault(x["path"].rsplit("/", 1)[1], []).append((x["rnk"], x["chunk"], x["n"]))
    for name, raw in data.items():
        n = Counter(raw[i : i + 4] for i in range(0, len(raw) - 3, 4))
        best = sorted(n.items(), key=lambda x: (-x[1], [-b for b in x[0]]))[:3]
        assert sorted(got.get(name, [])) == [(k + 1, c.hex(), m) for k, (c, m) in enumerate(best) if m > 1], name


def nested(rows):
    """What rows of one document stand for."""
    out = [] if rows[0][0][0] == documents.ITEM else {}
    for keys, value in rows:
        at = out
        for k, key in enumerate(keys[:-1]):
            at = at.setdefault(key, [] if keys[k + 1] == documents.ITEM else {})
        if keys[-1] == documents.ITEM:
            at.append(json.loads(value))
        else:
            at[keys[-1]] = json.loads(value)
    return out


ROWS = {
    "plain": [(["a"], "1"), (["b", "x"], '"t\\n€"'), (["b", "y", "[]"], "{}"), (["b", "y", "[]"], '{"k": [1, {"z": null}]}'), (["b", "z"], "[]"), (["c"], "null")],
    "list": [(["[]"], "1"), (["[]"], '{"a": {"b": 2}}')],
    "deep": [(["a", "b", "c", "d"], "1.5"), (["a", "b", "e"], "true"), (["a", "f", "g"], '"q"'), (["b"], "[[]]")],
    "quote": [(['"k"\\'], "1"), (["b/c", "[]"], "2")],
}


def document_rows(spark, docs):
    rows = [(t, k, keys, value) for t, some in docs.items() for k, (keys, value) in enumerate(some)]
    return spark.createDataFrame(rows, "target string, place int, keys array<string>, value string").repartition(3)


def test_documents_are_indented_json(spark, tmp_path):
    documents.write_documents(document_rows(spark, ROWS), f"{tmp_path}/d", "place")
    assert {f.name: f.read_text() for f in (tmp_path / "d").iterdir()} == {f"{t}.json": json.dumps(nested(rows), indent=2) for t, rows in ROWS.items()}
    documents.write_documents(document_rows(spark, {"list": [(["x"], "0")]}), f"file://{tmp_path}/d", "place")
    assert len(list((tmp_path / "d").iterdir())) == 4 and json.loads((tmp_path / "d" / "list.json").read_text()) == {"x": 0}


@pytest.mark.parametrize("bad", [(["a"], "{broken"), ([], "1"), (["[]", "x"], "1"), (["a", "[]"], "1")])
def test_a_job_that_fails_leaves_no_document(spark, tmp_path, bad):
    docs = {"good": [(["a"], "1")], "ill": [(["a", "b"], "1"), (["a", "c"], "2"), bad, bad]}
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of the task's error
        documents.write_documents(document_rows(spark, docs), f"{tmp_path}/d", "place")
    assert [f for f in (tmp_path / "d").rglob("*") if f.is_file()] == []


def test_triage_documents(spark, tmp_path):
    crashes = [(k % 2, f"id:{k}", f"/c/id:{k}", 10 - k % 4, "got SIGABRT" if k % 3 else 'fine #0  0x1 in f"x () ') for k in range(30)]
    df = spark.createDataFrame(crashes, "target_id int, file string, path string, size long, stdout string")
    documents.write_documents(triage.document_rows(df), f"{tmp_path}/t", "rnk", "part", "size", "file")
    for target in (0, 1):
        got = json.loads((tmp_path / "t" / f"{target}.json").read_text())
        assert got["total_crashes"] == 15 and got["unique_crash_frames"] == len(got["groups"]) == 2
        counts = [g["count"] for g in got["groups"].values()]
        assert counts == sorted(counts, reverse=True) and sum(counts) == 15
        assert all(g["crashes"] == sorted(g["crashes"], key=lambda x: (x["size"], x["file"])) and len(g["crashes"]) == g["count"] for g in got["groups"].values())
