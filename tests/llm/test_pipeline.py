"""The pipeline's stages against plain Python, on what each stage was given; nulls, empty tables, repeated rows and extra columns."""

import collections
import hashlib
import math
import re
import uuid
from html.parser import HTMLParser

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from concord.llm import common, importance, pii, queries, warc

from .test_operators import brute_components, brute_decontamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's name, what it got and what it gave."""
    docs, out = queries.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.cut(stage(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return out


def given(stages, k):
    name, docs, after = stages[k]
    return name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}


def test_stages_keep_columns(spark, stages):
    columns = queries.table(spark, SF, "documents").columns
    for name, before, after in stages[:-1]:
        assert after.columns == columns, name
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert stages[-1][2].columns == ["doc_id", "ids"]


def test_quality_stage_keeps_good_documents(spark, stages):
    _, before, after = given(stages, 0)
    labels = {r.doc_id: r for r in queries.table(spark, SF, "labels").collect()}
    good = [i in after for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert np.mean(good) > 0.9 and all(after[i] == before[i] for i in after)
    assert not any((before[i].text or "").split() == [] for i in after)


def test_duplicates_stage_against_jaccard(stages):
    _, before, after = given(stages, 1)
    want = {c for i, _, c in brute_components([(i, r.text) for i, r in before.items()])}
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_decontamination_stage_against_windows(spark, stages):
    _, before, after = given(stages, 2)
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    grams = collections.defaultdict(list)
    for i, t in items:
        for w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())):
            grams[w].append((i, t))
    for i, r in before.items():
        near = {x for w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r.text or "").lower())) for x in grams.get(w, [])} if len(r.text or "") < 2000 else set()
        if len(r.text or "") < 2000:
            assert (i in after) == (not brute_decontamination(r.text, sorted(near))[-1]), i


def test_redaction_stage_against_spans(spark, stages):
    name, before, after = given(stages, 3)
    spans = {r.doc_id: r.spans for r in pii.digest(pii.scan(stages[3][1])).collect()}
    assert set(after) == set(before)
    for i, r in before.items():
        found = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in spans[i].split(",") if x)]
        out, end = [], 0
        for s, e, k in sorted(found, key=lambda x: (x[0], -x[1], pii.KINDS.index(x[2]))):
            if s >= end:
                out += [r.text[end:s], f"[{k.upper()}]"]
            end = max(end, e)
        text = "".join([*out, (r.text or "")[end:]]) if found else r.text
        assert after[i].text == text and after[i].n_chars == len(text), i


def test_token_stage_against_sentencepiece(stages):
    _, before, after = given(stages, 4)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file(queries.PIECE_BPE))
    assert set(after) == set(before) and all(list(after[i].ids) == library.encode(before[i].text) for i in before)


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, quality string, _row long, z string, ids string"
    rows = [(1, None, "a", 1, "x", "y"), (2, "", "a", 1, "x", "y"), (3, "fine words here and there " * 3, "a", 1, "x", "y"), (3, "fine words here and there " * 3, "a", 1, "x", "y"), (None, "mail me: someone@site.example", "a", 1, "x", "y"), (5, "w" * 300_000 + " end", "a", 1, "x", "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            kept = got.collect()
            assert len(kept) <= len(data) and not any(r.text is None and r.doc_id != 1 for r in kept)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(data)
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 1, 2, 3, 5]
    assert {r.text for r in corpus_pipeline.redaction(spark, docs, SF).where("doc_id is null").collect()} == {"mail me: [EMAIL]"}


def test_near_duplicates_decide_by_row(spark):
    common_text = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five dozen liquor jugs near some very old river bank"
    near = common_text.replace("bank", "shore")
    other = "zebras wander across dry plains looking for water " * 2
    lonely = "another text that stands in the table without a name at all"
    rows = [(3, common_text), (7, near), (7, other), (8, other + "again"), (None, near), (None, lonely), (None, lonely), (9, ""), (9, None), (5, "b b b b b c"), (5, "b b b b b c"), (5, "B b b b b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, table, SF)
    assert got.columns == table.columns
    want = [(3, common_text), (7, other), (None, lonely), (9, ""), (9, None), (5, "B b b b b c")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_importance_weights_against_counts(spark):
    """Weights and keys from plain counts of the same buckets."""
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    ids = np.array(sorted(good), np.int64)
    held = dict(zip(ids.tolist(), (importance.mix(ids.view(importance.U)) % importance.U(2) == 1).tolist(), strict=True))
    raw, target, own = collections.Counter(), collections.Counter(), {}
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        own[r.doc_id] = importance.ngrams(data, np.array([0, len(data)]))[0].tolist()
        raw.update(own[r.doc_id])
        if good.get(r.doc_id) and not held[r.doc_id]:
            target.update(own[r.doc_id])
    share = sum(target.values()) / sum(raw.values())
    got = {r.doc_id: r for r in importance.draw(importance.score(docs, labels)).collect()}
    keys = []
    for i, buckets in own.items():
        weight = np.mean([math.log((target[b] + importance.PRIOR * share) / (raw[b] + importance.PRIOR) / share) for b in buckets]) if buckets else 0
        assert got[i].log_weight == pytest.approx(weight, abs=1e-5), i
        assert (got[i].gumbel_key is not None) == got[i].kept
        keys += [got[i].gumbel_key] if got[i].kept else []
    limit = sorted(keys, reverse=True)[round(importance.FRACTION * len(own)) - 1]
    assert all(r.sampled == (r.gumbel_key is not None and r.gumbel_key >= limit) for r in got.values())


class Reader(HTMLParser):
    """Text of a page by the standard library's parser."""

    HIDDEN = {"script", "style", "noscript", "template", "svg"}
    BLOCK = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav title blockquote pre td th dl dt dd hr main aside figure form".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        self.parts.append("\n" if tag in self.BLOCK else "")

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN
        self.parts.append("\n" if tag in self.BLOCK else "")

    def handle_data(self, data):
        self.parts.append("" if self.depth else data)

    def text(self):
        return re.sub(" ?\n[ \n]*", "\n", re.sub("[ \t\r\f\v\xa0]+", " ", "".join(self.parts))).strip()


def test_warc_records_against_the_standard_parser(spark):
    pages = queries.table(spark, SF, "pages")
    rows = collections.defaultdict(dict)
    for r in warc.derivatives(pages).collect():
        rows[r.page_id][r.record_type] = r
    space = uuid.uuid5(uuid.NAMESPACE_URL, "urn:concord:warc")
    for p in pages.collect():
        got = rows[p.page_id]
        body = (p.html or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        assert bytes(got["response"].block) == block and got["response"].target_uri == p.url
        name = "\n".join(("response", p.url, warc.DATE, warc.digest(block)))
        assert got["response"].record_id == f"<urn:uuid:{uuid.uuid5(space, name)}>"
        for kind in ("metadata", "conversion"):
            r = got[kind]
            assert r.refers_to == got["response"].record_id and r.target_uri == p.url
            assert r.block_digest == "sha1:" + warc.base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()
            assert ("WARC-Refers-To-Date", warc.DATE) in [(h.name, h.value) for h in r.headers]
        told = dict(h.split(": ", 1) for h in bytes(got["metadata"].block).decode().strip().split("\r\n"))
        assert told["source-header-content-type"] == "text/html; charset=utf-8" and told["conversion-record-id"] == got["conversion"].record_id
        assert bytes(got["conversion"].block).decode() == Reader(p.html or "").text(), p.page_id
