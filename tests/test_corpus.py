"""A corpus from folders to history: build, renew, refuse, verify, trace, export; sources and settings."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mosaica import api, errors, settings
from mosaica.functions import screening
from mosaica.operators import corpus, history
from mosaica.sources import folders

KEY = "gh" + "p_" + "a" * 36


def _folder(top, **files):
    for name, body in files.items():
        p = top / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return top


def _sync(spark, source, into, **o):
    return corpus.sync(folders.Folder(spark, str(source)), str(into), spark=spark, **o)


def test_life_of_a_corpus(spark, tmp_path):
    src, into = _folder(tmp_path / "s", a_dot_md="# A\r\n\r\nsee https://e.test/?utm_source=x&id=1.\r\n", b_dot_html="<nav>n</nav><p>B &amp; c</p>", c_dot_txt="﻿plain".encode("utf-8"), d_dot_pdf="no pdf", e_dot_xyz="?", git__x_dot_md="in"), tmp_path / "c"
    (src / ".git").mkdir()
    plan = corpus.plan(folders.Folder(spark, str(src)), str(into), spark=spark)
    assert not (into / "current").exists()
    one = _sync(spark, src, into)
    assert plan.run_id == one.run_id and one.totals["emitted"] == 4 and one.removals == 1
    assert {(r.origin, r.reason) for r in spark.read.parquet(str(into / "runs" / corpus.Corpus(spark, str(into)).run["folder"] / "skipped")).collect()} == {("d.pdf", "not_a_pdf"), ("e.xyz", "unknown_format"), (".git", "machinery")}
    docs = {r.unit_key: r for r in api.documents(spark, str(into)).collect()}
    assert docs["a.md"].text == "---\nlayer: fact\nproducer: mosaica.sync/1\n---\n# A\n\nsee https://e.test/?id=1.\n" and docs["a.md"].title == "A"
    assert docs["b.html"].text == "B & c\n\n" and docs["c.txt"].encoding == "utf-8-sig"
    assert corpus.verify(spark, str(into)).collect() == []

    again = _sync(spark, src, into)
    assert again.kept == 4 and again.run_id == one.run_id
    (src / "b.html").write_text("<p>changed</p>")
    (src / "c.txt").rename(src / "moved.txt")
    two = _sync(spark, src, into)
    assert two.kept == 2 and set(two.withdrawn) == {"documents/c.txt", "traces/c.txt.json"}
    assert corpus.verify(spark, str(into)).collect() == []
    entries, changes = history.from_lines(corpus.Corpus(spark, str(into)).journal_lines())
    log = history.log(entries, changes).collect()
    assert [(r.added, r.changed, r.removed, r.moved, r.total) for r in log] == [(0, 1, 0, 1, 4), (0, 0, 0, 0, 4), (4, 0, 0, 0, 4)]
    assert history.named(entries, log[0].entry) == 2
    blamed = {r.path: (r.first_seen, r.last_touched, r.revisions, r.formerly) for r in history.blame_followed(changes).collect()}
    assert blamed["documents/moved.txt"] == (0, 2, 1, ["documents/c.txt"]) and blamed["documents/b.html"] == (0, 2, 1, [])
    where = spark.createDataFrame([("documents/moved.txt",)], "path string")
    assert sorted(r.entry_seq for r in history.touching(changes, where).collect()) == [0, 2]
    assert [r.entry_seq for r in history.touching(changes, where, follow=False).collect()] == [2]

    stored = corpus.Corpus(spark, str(into))
    corpus.export(stored, str(tmp_path / "out"), "langchain")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["id"] for x in lines} == {"filesystem:a.md", "filesystem:b.html", "filesystem:moved.txt", "filesystem:git/x.md"}
    assert {x["metadata"]["body_offset"] for x in lines} == {0, 45}
    corpus.export(stored, str(tmp_path / "table"), "parquet")
    assert spark.read.parquet(str(tmp_path / "table")).columns == ["id", "text", *corpus.COLUMNS]

    at = docs["a.md"].text.index("see")
    asked = spark.createDataFrame([("documents/a.md", 0, at, at + 3), ("documents/a.md", 1, 0, 3)], "path string, range int, start int, end int")
    sources = folders.Folder(spark, str(src))
    content = sources.read(sources.discover()[0]).select(F.array_join("key_parts", "/").alias("unit_key"), "content")
    found = {r.range: r for r in corpus.trace(stored.table("documents"), asked, content).collect()}
    assert (found[0].status, found[0].src_start, found[0].byte_start, found[0].excerpt) == ("resolved", 7, 7, "see") and found[1].status == "synthetic"
    with pytest.raises(errors.TraceError):
        corpus.trace(stored.table("documents"), spark.createDataFrame([("documents/a.md", 0, 0, 9999)], asked.schema))
    assert corpus.Corpus.located(str(into / "runs")) == into.resolve()


def test_refusals_leave_the_corpus_as_it_is(spark, tmp_path):
    src, into = _folder(tmp_path / "s", a_dot_md="one"), tmp_path / "c"
    _sync(spark, src, into)
    before = (into / "current").read_text()
    (src / "k.md").write_text(f"token {KEY} here")
    with pytest.raises(errors.CredentialFoundError):
        _sync(spark, src, into)
    assert corpus.plan(folders.Folder(spark, str(src)), str(into), spark=spark).refusals == [("k.md", "github.pat-classic")]
    assert _sync(spark, src, tmp_path / "ok", settings=corpus.Settings(allowed=("github.pat-classic:k.md",))).totals["emitted"] == 2
    (src / "k.md").unlink()
    with pytest.raises(errors.DifferentSourceError):
        corpus.sync(folders.Vault(spark, str(src)), str(into), spark=spark)
    (src / "a.md").rename(src / "a.xyz")
    with pytest.raises(errors.EverythingSkippedError):
        _sync(spark, src, into)
    (src / "a.xyz").unlink()
    with pytest.raises(errors.EmptySourceError):
        _sync(spark, src, into)
    assert (into / "current").read_text() == before and [p.name for p in (into / "runs").iterdir()] == [json.loads(before)["folder"]]
    assert _sync(spark, src, into, withdraw_all=True).withdrawn == ["documents/a.md", "traces/a.md.json"]
    with pytest.raises(errors.SourceError):
        folders.Folder(spark, "/")


def test_fetched_pages(spark, tmp_path):
    src = _folder(tmp_path / "f", x__1_dot_html="<p>one</p>", x__2_dot_html="<p>two</p>", x__3_dot_html="<p>three</p>", x__4_dot_html="<p>four</p>")
    for n, body in ((1, folders.fetch_record("https://e.test/1", "2026-01-01", "https://e.test/c")), (2, folders.fetch_record("https://e.test/2", "2026-01-02", "https://e.test/c")), (3, "[]")):
        (src / "x" / f"{n}.html.fetch.json").write_text(body)
    found, skipped = folders.Fetched(spark, str(src)).discover()
    assert {(r.origin, r.reason) for r in skipped.collect()} == {("x/2.html", "duplicate"), ("x/3.html", "bad_fetch_record")}
    assert {tuple(r.key_parts) for r in found.collect()} == {("x", "1.md"), ("x", "4.md")}
    corpus.sync(folders.Fetched(spark, str(src)), str(tmp_path / "c"), spark=spark)
    text = api.documents(spark, str(tmp_path / "c")).where("unit_key = 'x/1.md'").first().text
    assert text == "---\nlayer: fact\nproducer: mosaica.sync/1\nsource_url: https://e.test/1\nfetched_at: 2026-01-01\ncanonical_url: https://e.test/c\n---\none\n\n"


def test_archives(spark, tmp_path):
    inner = tmp_path / "Part-1.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr(f"Done! {'a' * 32}.md", "# A")
        z.writestr(f"T {'b' * 32}.csv", "x,y")
        z.writestr("no id.md", "x")
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.write(inner, "Part-1.zip")
        z.writestr("pic.png", "x")
        z.writestr("bad.zip", "x")
    inner.unlink()
    found, skipped = folders.Export(spark, str(tmp_path)).discover()
    assert sorted(r.key_parts[0] for r in found.collect()) == ["a" * 32 + ".md", "b" * 32 + ".csv"]
    assert {r.reason for r in skipped.collect()} == {"no_page_id", "unknown_format", "unreadable_archive"}
    done = corpus.sync(folders.Export(spark, str(tmp_path)), str(tmp_path / "c"), spark=spark)
    assert done.totals["emitted"] == 1 and {r.reason for r in done.skipped.collect()} == {"no_page_id", "unknown_format", "unreadable_archive", "no_converter"}


def test_tampering_is_found(spark, tmp_path):
    into = tmp_path / "c"
    _sync(spark, _folder(tmp_path / "s", a_dot_md="one", b_dot_md="two"), into)
    run = json.loads((into / "current").read_text())
    (into / "current").write_text(json.dumps(run | {"coverage": run["coverage"] | {"characters": 1}}))
    assert {(r.invariant, r.subject) for r in corpus.verify(spark, str(into)).collect()} == {("manifest 2", "coverage.characters")}
    (into / "current").write_text(json.dumps(run | {"run_id": "sha256:0"}))
    assert {r.invariant for r in corpus.verify(spark, str(into)).collect()} == {"manifest 1", "journal 1"}
    (into / "current").write_text(json.dumps(run | {"contract": "other"}))
    with pytest.raises(errors.ContractError):
        corpus.verify(spark, str(into))


def test_screening():
    assert [f[0] for f in screening._ranges(f"x {KEY}. y{KEY}", ("signatures",))] == ["github.pat-classic"]
    assert screening._ranges("-----BEGIN " + "RSA PRIVATE KEY-----", ("signatures",))[0][0] == "key.pem-private"
    assert screening.entropy("") == 0.0 and screening.entropy("ab") == 1.0
    assert [f[0] for f in screening._ranges("0123456789abcdef0123456789abcdef " + "a" * 40, ("entropy",))] == ["entropy.hex"]


def test_settings(spark, tmp_path):
    (tmp_path / "mosaica.toml").write_text('rules = "none"\npdf-word-gap = -100\n')
    got = settings.load(str(tmp_path), {"MOSAICA_ALLOW": "a:b, c:d"}, screener="signatures+entropy")
    assert [(got[k].value, got[k].origin) for k in ("rules", "pdf-word-gap", "allow", "screener", "into")] == [("none", "mosaica.toml"), (-100.0, "mosaica.toml"), (["a:b", "c:d"], "MOSAICA_ALLOW"), ("signatures+entropy", "argument"), ("synced", "default")]
    assert settings.of_run(got).tiers == ("signatures", "entropy") and settings.table(spark, got).count() == 9
    for bad in ('rulez = "x"', 'rules = "x"', "allow = [1]", "= 3"):
        (tmp_path / "mosaica.toml").write_text(bad)
        with pytest.raises(errors.ContractError):
            settings.load(str(tmp_path), {})
    with pytest.raises(errors.ContractError):
        settings.load(str(tmp_path.parent), {"MOSAICA_CONVERTERS": "x"})


def test_calls(spark):
    units = spark.createDataFrame([("a.md", "x https://e.test/?utm_a=1 y"), ("b.bin", "?")], "path string, content string")
    docs = {r.path: r for r in api.convert(units).collect()}
    assert docs["a.md"].text == "x https://e.test/ y" and docs["b.bin"].reason == "no_converter"
    with pytest.raises(errors.CredentialFoundError):
        api.convert(spark.createDataFrame([("a.md", KEY)], units.schema))
    assert api.media_type_of("A.HTM") == "text/html"
    asked = spark.createDataFrame([("a.md", 0, 0, 1)], "path string, range int, start int, end int")
    assert api.where(api.convert(units).where("reason is null"), asked).first().kinds == ["verbatim"]
