"""Rules by their values: conversions, statuses, headings, signs, records that can't be read, matching and routing."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from concord.functions import convert, text
from concord.functions.convert import Target
from concord.operators import alignment, batch, discipline, extract, generate, profile, reconcile, reports, scoring
from concord.plans import alignment_queries as fixtures
from concord.plans import storage
from concord.sources import files, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in {k: kind(v) for k, v in values.items()}.items()))
    return row.select(column.alias("x")).first()["x"]


def kind(v):
    if isinstance(v, list):
        return "array<string>"
    return {bool: "boolean", int: "long", float: "double"}.get(type(v), "string")


@pytest.mark.parametrize("raw, integer, want", [("90", True, 90), ("90.0", True, 90), ("1e3", True, 1000), ("90.5", True, None), (" 1,234 ", True, 1234), ("n/a", True, None), ("9007199254740993", True, 9007199254740993), ("88.5", False, 88.5), ("-2", False, -2.0), ("4 stars", False, None), ("", False, None)])
def test_cast_number(spark, raw, integer, want):
    assert one(spark, convert.cast_number(F.col("v"), integer), v=raw) == want


@pytest.mark.parametrize("raw, want", [("2001", "2001"), ("10/09/2007", "2007"), ("October 27, 2017", "2017"), ("27.10.2017", "2017"), ("31.12.2020", "2020"), ("2007-05-01", "2007"), ("oct 3, 1999", "1999"), ("2007-05-01T10:00:00", None), ("n/a", None)])
def test_years(spark, raw, want):
    assert one(spark, convert.parse_date(F.col("v"), True), v=raw) == want


@pytest.mark.parametrize("raw, want", [("10/09/2007", "2007-09-10"), ("12/31/2020", "2020-12-31"), ("31.12.2020", "2020-12-31"), ("2001", "2001-01-01"), ("2020/2/3", "2020-02-03"), ("3 May 2020", None), ("May 3, 2020", "2020-05-03")])
def test_dates(spark, raw, want):
    assert one(spark, convert.parse_date(F.col("v")), v=raw) == want


CASES = [
    ("releaseYear", "2001", "string", "2001"), ("releaseYear", "2007", "integer", "2007"), ("releaseYear", "10/09/2007", "string", "2007"), ("criticScore", "97", "string", 97), ("criticScore", "97.9", "number", 97), ("criticScore", "true", "boolean", None),
    ("genres", "Shooter;Action", "string", ["Shooter", "Action"]), ("genres", " ; ", "string", None), ("platform", "PC", "string", "Windows PC"), ("platform", "Xbox", "string", "Xbox"), ("platform", "Linux", "string", None), ("ESRB", "K-A", "string", "E"), ("ESRB", "Mature", "string", "M"), ("name", "x", "string", "x"), ("name", "{}", "object", None),
]


@pytest.mark.parametrize("target, value, jtype, want", CASES)
def test_conversions(spark, target, value, jtype, want):
    t = next(t for t in fixtures.GAME if t.name == target)
    assert one(spark, convert.convert(t, F.col("v"), F.col("j")), v=value, j=jtype) == want


@pytest.mark.parametrize("stages, want", [([], "pending"), (["completed", "pending"], "pending"), (["completed", "processing"], "processing"), (["completed", "skipped"], "completed"), (["failed", "completed"], "failed")])
def test_overall_status(spark, stages, want):
    assert one(spark, reports.overall_status(F.col("s")), s=stages) == want


@pytest.mark.parametrize("draft, fact, proposals, want", [
    ("Low", None, [("1", "High"), ("2", "Medium")], ("conflict", None)), ("4.1", "4.2.1", [("1", "4.2.1")], ("corrected", "4.2.1")), ("", "x", [], ("filled", "x")), (" Four Hour", "four hour", [], ("unchanged", "four hour")),
    ("a", None, [("1", "a")], ("corrected", "a")), (None, None, [("1", "a")], ("filled", "a")), ("a", None, [], ("needs_review", "a")), (None, None, [], ("needs_review", None)), ("a", None, [("1", None)], ("needs_review", "a")), ("a", "b", [("1", "c"), ("2", "c")], ("corrected", "b")),
])
def test_resolve(spark, draft, fact, proposals, want):
    df = spark.createDataFrame([(draft, fact, proposals)], "d string, f string, c array<struct<id:string,new_value:string>>")
    status, value, _ = reconcile.resolve(F.col("d"), F.col("f"), F.col("c"))
    assert tuple(df.select(status, value).first()) == want


@pytest.mark.parametrize("value, corpus, want", [("", "anything", True), ("Four  Hours", "it took four hours", True), ("five", "four", False)])
def test_grounded(spark, value, corpus, want):
    assert one(spark, reconcile.grounded(F.col("v"), F.col("c")), v=value, c=corpus) is want


def test_valid_operations_keep_blank_values(spark):
    ops = spark.createDataFrame([("replace", " "), ("replace", ""), ("flag", None), ("drop", "x")], "o string, v string")
    assert [r.reason for r in reconcile.valid_operations(ops, "o", "v", ["replace", "flag"], ["replace"]).collect()] == [None, "empty_value", None, "unknown_operation"]


@pytest.mark.parametrize("said, want", [("This is UNACCEPTABLE and wrong, thanks", "negative"), ("great, perfect", "positive"), ("an error, but good", "neutral")])
def test_sentiment(spark, said, want):
    assert one(spark, text.sentiment(F.col("t")), t=said) == want


@pytest.mark.parametrize("token", ["a", "packet", "loss", "42"])
def test_hashed_slots(spark, token):
    h = int(hashlib.md5(token.encode()).hexdigest(), 16)
    assert (one(spark, text.hash_slot(F.col("t")), t=token), one(spark, text.hash_sign(F.col("t")), t=token)) == (h % 256, 1 if h >> 8 & 1 else -1)


def test_markdown_blocks(spark):
    md = "# One\r\n  ## Two \n#three\n- item\n* other\n-not\n\n  text \x0bmore"
    got = files.blocks(spark.createDataFrame([(1, md)], "doc long, text string"), "doc", "text").orderBy("ord").collect()
    assert [(r.type, r.text, r.section) for r in got] == [("heading", "# One", "One"), ("heading", "## Two", "Two"), ("heading", "#three", "three"), ("list_item", "- item", "three"), ("list_item", "* other", "three"), ("paragraph", "-not", "three"), ("paragraph", "text", "three"), ("paragraph", "more", "three")]


def test_no_record_is_lost(spark):
    deep = '{"a": ' * 40 + "[[1, [2]]]" + "}" * 40
    rows = ["{}", '{"a": 1, "a": 2}', '{"a": ', "[1]", None, '"x"', deep, '{"t": [], "o": {}, "n": null, "s": "[{"}']
    docs = spark.createDataFrame(list(enumerate(rows)), "rec int, record string")
    cells = {(r.rec, r.path, r.jtype, r.value) for r in profile.cells(docs, ["rec"], "record").collect()}
    path = ".".join("a" * 40)
    assert cells == {(1, "a", "integer", "2"), (6, path + "[][]", "integer", "1"), (6, path + "[][][]", "integer", "2"), (7, "t[]", "array", None), (7, "n", "null", None), (7, "s", "string", "[{")}
    assert {r.rec: r.reason for r in profile.quarantine(docs, "record").collect()} == {2: "unparsable", 3: "not_an_object", 4: "missing", 5: "not_an_object"}
    assert profile.totals(docs, "record").first()["total"] == 4


def test_shape_hash_and_bookkeeping(spark):
    docs = spark.createDataFrame([(1, '{"gameTitle": "x", "internal_id": 1, "_scraped_at": "t", "genreList": ["a"]}'), (2, '{"game_title": 5, "genre-list": ["b", "c"]}')], "doc int, record string")
    got = {r.doc: r for r in profile.signatures(profile.cells(docs, ["doc"], "record"), "doc").collect()}
    want = hashlib.sha256(json.dumps(["game title", "genre list[]"]).encode()).hexdigest()[:16]
    assert got[1].shape == got[2].shape == want and got[1].types["game title"] == "string" and got[2].types["game title"] == "integer"


def test_alignment_of_the_ladder(spark):
    docs = fixtures.shape_records(spark)
    long = storage.cut(profile.cells(docs, ["kind", "rec"], "record"), "cells")
    mapping = storage.cut(fixtures.match_shapes(spark), "mapping")
    golden = alignment.execute(docs, long, ["rec"], mapping, fixtures.GAME, ["kind"])
    golden = golden.withColumn("issues", alignment.issues(fixtures.GAME, [t.name for t in fixtures.GAME], "provenance")).withColumn("ok", alignment.conformant(fixtures.GAME))
    got = {(r.kind, r.rec): r for r in golden.collect()}
    assert len(got) == 20 and not any(r.issues for r in got.values())
    for shape in ("golden", "nested", "synonyms"):
        for k, want in enumerate(fixtures.SHAPES["golden"]):
            assert {t.name: got[shape, k][t.name] for t in fixtures.GAME} == want, shape
    assert {s for s, k in got if got[s, k].ok} == {"golden", "renamed", "nested", "synonyms", "arity", "conflict", "decoys"}
    status = {p.target: p.status for p in got["conflict", 0].provenance}
    assert status["publisher"] == "conflict" and status["name"] == "filled" and {p.status for p in got["opaque", 0].provenance} == {"needs_review"}


def test_self_benchmark(spark):
    records = [{"internal_id": str(k), "game_title": t, "year_published": y, "made_by": m, "publisher": "P", "hw": h, "genres": g, "critic_score": c, "age_rating": a, "scraped_at": "2024-01-01"} for k, (t, y, m, h, g, c, a) in enumerate([("One", "2001", "A", "Xbox", "Shooter;Action", "97", "M"), ("Two", "10/09/2007", "B", "PC", "Platformer", "90", "Teen"), ("Three", "October 27, 2017", "C", "Switch", "Puzzle", "97", "E10+")])]
    docs = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "rec int, record string")
    long = storage.cut(profile.cells(docs, ["rec"], "record"), "cells")
    mapping = alignment.infer_mapping(profile.profile(long, ["rec"], None, profile.totals(docs, "record")), alignment.target_table(spark, fixtures.GAME))
    found = mapping.where("status = 'mapped'").select("path", "target")
    gold = spark.createDataFrame([("game_title", "name"), ("year_published", "releaseYear"), ("made_by", "developer"), ("publisher", "publisher"), ("hw", "platform"), ("genres", "genres"), ("critic_score", "criticScore"), ("age_rating", "ESRB")], "path string, target string")
    r = scoring.precision_recall(found, gold, ["path", "target"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (6, 0, 2, 1.0, 0.75, 0.857143)


def test_library_keeps_rejected_shapes(spark):
    fields = [Target("orderId", ["integer"], True), Target("note")]
    docs = spark.createDataFrame([(k, 0, json.dumps({"order_id": k, "note": "n"})) for k in range(3)], "doc int, rec int, record string")
    empty = batch.empty_library(spark)
    first = batch.run_batch(batch.plan_batch(docs, "doc", "rec", "record", fields, empty), "doc", "rec", fields, empty, "t")
    assert [tuple(r) for r in first.outcomes.select("pathway", "n_docs", "conformed").collect()] == [("novel_research", 3, 3)]
    library = storage.cut(batch.decide(batch.register(empty, first.learned), "rejected"), "library")
    again = batch.plan_batch(docs, "doc", "rec", "record", fields, library)
    assert [r.pathway for r in again.decisions.collect()] == ["declined"]
    assert [r.state for r in batch.register(library, first.learned).collect()] == ["rejected"]
    poor = spark.createDataFrame([(1, 0, '{"f1": "x"}')], "doc int, rec int, record string")
    assert [r.pathway for r in batch.plan_batch(poor, "doc", "rec", "record", fields, empty, research=False).decisions.collect()] == ["reject_irrelevant"]


def test_fonts_and_wrong_values(spark):
    assert one(spark, discipline.font_family(F.col("f")), f=" Helvetica ") == "Liberation Sans" and one(spark, discipline.font_family(F.col("f")), f="Odd") == "Odd"
    assert one(spark, text.wrong_value(F.col("v")), v="4.2.9") == "4.2.0" and one(spark, text.wrong_value(F.col("v")), v="High") == "High (DRAFT - unverified)"
    assert one(spark, generate.misspelt(F.col("v"), F.lit(1)), v="developer") != "developer"
    assert one(spark, extract.strip_label(F.col("v")), v="Preliminary Assessment it works") == "it works"


def test_office_files_open_as_packages(spark):
    blocks = [("heading", "A & B"), ("paragraph", "<x>"), ("list_item", "one"), ("heading", "C")]
    made = spark.createDataFrame([("a.docx", bytearray(sinks.docx(blocks))), ("b.pptx", bytearray(sinks.pptx(blocks))), ("c.docx", bytearray(b"broken"))], "path string, content binary")
    got = {}
    for r in files.office_blocks(made).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.type, r.text))
    assert got["a.docx"] == blocks and got["b.pptx"] == [("heading", "A & B"), ("paragraph", "<x>"), ("paragraph", "one"), ("heading", "C")] and got["c.docx"][0][0] == "failed"


def test_clusters_without_shared_folder_are_refused(spark, monkeypatch):
    class Session:
        sparkContext = type("C", (), {"master": "spark://x", "getConf": lambda self: type("K", (), {"get": lambda self, k: None})()})()
        conf = type("K", (), {"get": lambda self, k, d: None})()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


def test_chunks_against_a_fold(spark):
    from concord.operators import retrieval

    docs = [(1, "\n".join(["# A", "x" * 500, "y" * 400, "z", "# B", "## C", "w" * 900, "end"])), (2, "one\n\ntwo"), (3, "")]
    got = {}
    for r in retrieval.chunks(files.blocks(spark.createDataFrame(docs, "doc long, text string"), "doc", "text"), "doc").orderBy("doc", "chunk").collect():
        got.setdefault(r.doc, []).append((r.text, r.n_blocks))
    want = {}
    for d, t in docs:
        out, size = [], 0
        for line in filter(str.strip, t.split("\n")):
            if out and size and (line.startswith("#") or size >= 800):
                out.append([])
                size = 0
            if not out:
                out.append([])
            out[-1].append(line)
            size += len(line)
        if out:
            want[d] = [("\n".join(x), len(x)) for x in out]
    assert got == want


def test_edits_keep_what_was_not_meant():
    from concord.operators import edits

    text = "First stays. The value is 3 in all. Last stays!"
    assert edits.spliced_text(text, "The value is 4 in all.") == "First stays. The value is 4 in all. Last stays!"
    assert edits.spliced_text("one sentence", "another") == "another" and edits.tagged_text("a b c d", "a x c") == "a x c"


def test_operations_by_name(spark):
    from concord import api

    schema = {"title": "game", "required": ["name"], "properties": {"name": {"type": "string", "description": "The title of the game"}, "criticScore": {"type": "integer", "minimum": 0, "maximum": 100}, "genres": {"type": "array", "items": {"type": "string"}}}}
    data = [{"title": "A", "critic_score": "90", "genres": "x;y"}, {"title": "B", "critic_score": "n/a", "genres": ["z"]}]
    got = {r.rec: r for r in api.run_alignment(spark, data, schema).collect()}
    assert (got[0]["name"], got[0].criticScore, got[0].genres) == ("A", 90, ["x", "y"]) and got[0].conformant and got[1].criticScore is None
    assert api.relevance_of(spark, data, schema).first().verdict == "convertible" and api.relevance_of(spark, [{"wind": 1}], schema).first().verdict == "reject"
    assert api.signature_of(spark, [{"gameTitle": 1}]).first().shape == api.signature_of(spark, [{"game_title": "x"}]).first().shape
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "packet loss on the router")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "router packet loss")], "query_id long, text string")
    assert [(r.doc_id, r["rank"]) for r in api.search(docs, asked).orderBy("rank").collect()][0] == (2, 1)
