"""Language ID, PII, license scan, decontamination: brute force, odd inputs, empty tables."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from inboxlens.llm import decontaminate as D
from inboxlens.llm import langid, licenses, pii
from inboxlens.llm.common import doc_bucket
from tests.conftest import SF001, SF01
from tests.llm.conftest import MESSY


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")     # some 200 held-out texts
    held_out = doc_bucket(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    assert set(model) == {"de", "en", "es", "fr"} and max(map(len, model.values())) < langid.SAMPLE_ROWS * (4 * langid.SAMPLE_CHARS + 1)
    found = langid.identify(docs.where(held_out), model)
    assert found.columns == [*docs.columns, "lang_pred", "score", "rejected"]
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    assert found.where("not rejected").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_language_odd_inputs(messy, nothing):
    model = {"de": b"der die das und nicht eine", "en": b"one two words the and of"}
    rows = langid.identify(messy, model).collect()
    assert len(rows) == len(MESSY) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        blank = not re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (not blank or r["rejected"])
    assert {r["lang_pred"] for r in langid.identify(messy, {}).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0 and langid.train(nothing) == {}
    marks = messy.sparkSession.createDataFrame([("\u0301",), ("1 \u0301\u0902 2",), (" ",)], "text string")
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(marks, model).collect()} == {("und", 0.0, True)}
    assert langid.decide([b"abc"], {"xx": b"abc", "yy": b"abc"}) == [("xx", 0.0)]      # a tie


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def _passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
            "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


ODD_PII = [
    "a@b.c_d@e.f x@y.z.w-1 é😀 user.name+tag@ex-ample.co.uk, call +49 (30) 123-4567 8", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 card", "7" * 30000, "1 " * 20000, "a." * 20000 + "@x.y", "@" * 1000, "+1" * 5000,
    "+1 2 3 4 5 6 7 8 9 " * 300, " ".join(f"u{i}@h{i}.com" for i in range(500)), "😀" * 50 + " 10.0.0.1",
]


def test_pii_against_regular_expressions(spark, docs, messy):
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD_PII)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd).union(messy.where("doc_id is not null").select(F.col("doc_id") + 2000, "text"))
    got = {r["doc_id"]: r for r in pii.digest(pii.spans(rows)).collect()}
    for i, text in rows.collect():
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if _passes(k, m.group())]
        text_of = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text_of.encode()).hexdigest(), (i, got[i]["spans"][:200])
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]


def test_pii_checksums_and_context(spark, nothing):
    t = "pay to IBAN DE89 3704 0044 0532 0130 00 now" + "." * 60 + "GB82WEST12345698765432" + "." * 60 + "DE89370400440532013001"
    [r] = pii.spans(spark.createDataFrame([(t, 1)], "text string, pii int")).collect()
    assert [(s["kind"], t[s["start"]:s["end"]], s["score"]) for s in r["pii"]] == [
        ("iban", "DE89 3704 0044 0532 0130 00", 0.95), ("iban", "GB82WEST12345698765432", 0.85)]
    assert pii.spans(nothing).count() == 0


def test_iban_ends_where_its_number_ends(spark):
    rows = [("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
            ("GB82WEST12345698765432 A fee", "GB82WEST12345698765432"), ("DE89370400440532013000 2024-01-01", "DE89370400440532013000"),
            ("NO93 8601 1117 947 12 PCS", "NO93 8601 1117 947"), ("MT84MALT011000012345MTLCAST001S EUR 5", "MT84MALT011000012345MTLCAST001S"),
            ("FR14 2004 1010 0505 0001 3M02 606 DE89370400440532013000", "FR14 2004 1010 0505 0001 3M02 606"),
            ("DE8937040044053201300 0X", None), ("DE89 3704 0044 0532 0130 01 BIC", None)]
    found = pii.spans(spark.createDataFrame(rows, "text string, want string")).collect()
    for r in found:
        values = [r["text"][s["start"]:s["end"]] for s in r["pii"] if s["kind"] == "iban"]
        assert values[:1] == ([r["want"]] if r["want"] else []), r["text"]
    assert sum(s["kind"] == "iban" for r in found for s in r["pii"]) == 7


def test_license_scan_equals_all_windows(spark, docs, messy, nothing):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    key = ["doc_id", "license", "template", "containment"]
    got = sorted(map(tuple, licenses.scan(docs).select(*key).collect()))
    assert got and got == sorted(con.sql(licenses.oracle_sql()).fetchall())
    assert [tuple(r)[:3] for r in licenses.scan(messy).select(*key).collect()] == [(14, "MIT", 0)]
    assert licenses.scan(nothing).count() == 0 and licenses.scan(docs, templates=[("X", "too short")]).count() == 0


def test_license_long_template_far_into_a_long_text(spark):
    name, body = licenses.TEMPLATES[2]
    words = body.split()
    words[20] = "changed"
    text = "word " * 3333 + " ".join(words).upper() + " tail" * 777
    rows = spark.createDataFrame([(1, text), (1, text), (2, " ".join(words[:30]))], "doc_id long, text string")
    got = [(r["doc_id"], r["license"], r["template"]) for r in licenses.scan(rows).collect()]
    assert got == [(1, name, 2)] * 2
    assert licenses.bands(1, 1) >= 1 and licenses.bands(64, 33) > licenses.bands(64, 64)


def test_every_license_line_of_documents_gives_a_row(spark):
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("text is not null")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    for line, name in lines.items():
        want = {(r["doc_id"], name) for r in docs.where(F.col("text").contains(line)).collect()}
        assert want and want <= got


def test_each_template_is_found_under_its_own_name(spark):
    rows = [(k, f"before it. {t} After it.") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {(r["doc_id"], r["license"], r["template"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, n, k) for k, (n, _) in enumerate(licenses.TEMPLATES)} <= got
    # Beside its own name a notice gives nothing by the templates after the first ten.
    assert all(n == licenses.TEMPLATES[k][0] for k, n, t in got if t >= 10)
    names = {n for _, n, _ in got}
    assert {"CC-BY-SA-4.0", "CC-BY-NC-4.0", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "BSD-2-Clause", "ISC", "Unlicense"} <= names


def _contaminated_brute(rows, items):
    out = set()
    for i, text in rows:
        w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        sets = {n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        for x in items:
            if all(D.contained(D.shingles(p), sets.get(min(len(p), 5), set())) >= 0.8 for p in (x.question, x.answer)):
                out.add((i, x.item_id))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF001}/benchmark.parquet")


def test_decontamination_against_every_pair(spark, docs, pdocs, benchmark):
    items = [x for x in (D.split_item(*r) for r in benchmark.collect()) if x]
    x = max(items, key=lambda x: len(x.question))
    q, planted = [*x.question], []
    planted.append((9001, "before " * 400 + " ".join(q + x.answer).upper() + " after" * 300))
    planted.append((9002, " ".join(q[:len(q) // 2])))                     # half of the question, no answer
    q[len(q) // 2] = "changed"
    planted.append((9003, " ".join(q + x.answer)))
    more = spark.createDataFrame(planted, "doc_id long, text string")
    want = _contaminated_brute([*zip(pdocs.doc_id, pdocs.text), *planted], items)
    assert (9001, x.item_id) in want and not any(i == 9002 for i, _ in want)
    for index_bytes in (D.INDEX_BYTES, 1500):
        got = D.contaminated(docs.select("doc_id", "text").union(more), benchmark, index_bytes=index_bytes)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_decontamination_of_any_script_and_of_repeated_words(spark):
    texts = ["\u0939\u093f\u0928\u094d\u0926\u0940 \u092e\u0947\u0902 \u092f\u0939 \u090f\u0915 \u0932\u0902\u092c\u093e \u092a\u094d\u0930\u0936\u094d\u0928 \u0939\u0948? \u0939\u093e\u0901 \u091c\u0940.",
             "Le cafe\u0301 de la gare e\u0301tait ferme\u0301 hier soir. Pourquoi donc cela?", "go go go go go go go.", "la la la la la la la la. no no no no no no."]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k, f"{'before ' * 100}{t} {'after ' * 200}") for k, t in enumerate(texts)]
    rows += [(10, "go on and let it go"), (11, "la la la la la la"), (12, None)]
    for more in (0, 200):     # with other items in the index, too
        known = items.union(spark.createDataFrame([(100 + k, f"other{k} item{k} with{k} words{k} in{k} it{k}.") for k in range(more)], items.schema)) if more else items
        got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(4)}


def test_decontamination_odd_inputs(spark, messy, nothing, benchmark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "one. One!"), (4, "...")],
                                  "item_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["item_id"] or -1) for r in D.contaminated(messy, items).collect()))
    assert got == sorted([(6, 3), (6, 3), (7, 3), (7, 3), (4, -1), (5, -1), (5, -1), (-1, -1)])
    assert D.contaminated(nothing, items).count() == 0 and D.contaminated(messy, benchmark.limit(0)).count() == 0


def test_postings_are_added_up_in_bounded_pieces(monkeypatch):
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc
    items = [D.Item(k, [f"rare{(k + j) % 40}" for j in range(12)], [f"answer{k % 7}"]) for k in range(2000)]
    df = {}
    for x in items:
        for t in set(x.question + x.answer):
            df[t] = df.get(t, 0) + 1
    index = D.Index.build(items, df, len(items), 13)
    texts = pa.array([" ".join(f"rare{(7 * d + i * i) % 40}" for i in range(40)) + " far" * 90 + f" answer{d % 7}" for d in range(400)])
    empty = pa.array([" ".join(items[5].question + items[5].answer), ""])
    D.passages(empty, index)
    tracemalloc.start()
    got = D.passages(texts, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, f"{peak >> 20} MB for {texts.nbytes >> 10} KB of text"
    tids = pc.index_in(pa.array([w for t in texts.to_pylist() for w in t.split()]), value_set=index.vocabulary)
    tids = tids.fill_null(-1).to_numpy()
    cells = D.np.arange(len(tids)) // index.width
    whole = None
    for limit in (1 << 40, 1 << 18, 5000, 1):
        monkeypatch.setattr(D, "POSTINGS", limit)
        found = D._candidates(tids, cells, index).tolist()
        whole = found if whole is None else whole
        assert found == whole and found
    assert len(got) == 400 and {k for k, *_ in D.passages(empty, index)[0]} >= {5}


def test_decontamination_starts_no_workers_for_an_empty_table(spark, docs, benchmark):
    for items in (benchmark, benchmark.limit(0)):
        plan = D.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan


def test_block_max_wand_finds_all_above_the_threshold():
    import random
    rnd = random.Random(5)
    items = [D.Item(k, [f"w{min(int(rnd.expovariate(0.05)), 200)}" for _ in range(rnd.randint(3, 30))], []) for k in range(150)]
    df = {}
    for x in items:
        for t in set(x.question):
            df[t] = df.get(t, 0) + 1
    index = D.Index.build(items, df, len(items), 15)
    for _ in range(60):
        query = rnd.sample(range(len(index.terms)), rnd.randint(1, len(index.terms)))
        want = {k for k, x in enumerate(items) if sum(w for t, w in x.weights.items() if t in set(query)) >= 1 - 1e-9}
        assert {k for k, _ in index.search(sorted(query))} == want
