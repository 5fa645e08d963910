"""Training-data operators against brute force, round trips and small defined cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stenbro.llm import canonical, entities, garbled, leaks, residue, tokens, variants
from stenbro.llm.bpe import PATTERN, UnitEncoder, load_ranks

VOCABULARY = tokens.BYTE_BPE_50K
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
NASTY = ["", "  ", " a", "a  b", "a   b", "\n a", "a \n b", "\n\n", "a\n\n b", "x<|endoftext|>y", "I'll we've 'S don't", "æøå 日本語 😀", "a\x1c b", "a\x85 b", "1234567890" * 30, "aaaaaaaaaaaaaaa", "\nx", "x \n\nBl"]


@pytest.fixture(scope="module")
def other():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    return NASTY + ["".join(rng.choice(" \n\t  abÆ'sl1,.<😀\x1c") for _ in range(rng.randint(0, 40))) for _ in range(n)]


@needs_vocabulary
def test_ids_equal_another_tokenizer(other):
    xs = texts(5000)
    ids, at = UnitEncoder(load_ranks(VOCABULARY)).encode(xs)
    assert all(ids[at[k] : at[k + 1]].tolist() == other.encode_ordinary(x) for k, x in enumerate(xs))


@needs_vocabulary
def test_token_ids_of_null_empty_and_extra_columns(spark, other):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "så hej", "k"), (3, "så hej", "k")], "doc_id long, text string, key string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, other.encode_ordinary("så hej")), (3, other.encode_ordinary("så hej"))]
    assert tokens.token_ids(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
@pytest.mark.parametrize("text", ["En sætning her. " * 400, "x" * 3000, "日本" * 900, "a\n\nb " * 600, "ab1!" * 900 + " slut"])
def test_pieces(spark, other, text):
    df = spark.createDataFrame([(1, text), (2, None), (3, "kort"), (4, "")], "doc_id long, text string")
    rows = tokens.split_oversized(df, "doc_id", "text", 200, 20).collect()
    assert [r.doc_id for r in rows] == [1] and rows[0].n_tokens == len(other.encode_ordinary(text))
    end = 0
    for p in rows[0].pieces:
        assert p.text == text[p.start : p.end] and p.start <= end and len(other.encode_ordinary(p.text)) == p.tokens <= 200
        end = p.end
    assert end == len(text)


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in "ka lo mi nu pe ri so ta vu xe".split() for b in "bor den fil gam hus jal".split()]


def test_leaks_against_alignment_of_everything(spark):
    rng = random.Random(3)
    items = [(i, passage(rng, 60)) for i in range(12)]
    docs = []
    for d in range(80):
        own = items[d % 12][1].split()
        part = own[5:45] if d % 3 == 0 else own[:10] if d % 3 == 1 else []
        part = [w for w in part if rng.random() > 0.08]
        if d % 2:
            part = [x for w in part for x in ([w, "altså"] if rng.random() < 0.1 else [w])]
        docs.append((d, " ".join(["og"] * 30 + part + ["men"] * 30)))
    docs += [(900, None), (901, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(a, b, "doc_id", "text", "item_id", "passage").collect()}
    model = leaks.Items([i for i, _ in items], [p for _, p in items], 1 / 3)
    want = set()
    for d, t in docs:
        if t:
            x = np.array([model.vocabulary[w] for w in leaks.words_of(t)], np.int32)
            n = leaks.matched(model.words, [x] * len(items))
            want |= {(d, items[k][0]) for k in range(len(items)) if n[k] >= model.asked[k]}
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


def test_edit_distances():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert canonical.levenshtein(a, b) == row[-1] and canonical.damerau(a, b) <= row[-1] <= 2 * canonical.damerau(a, b)


def test_bk_tree_returns_all_within():
    rng = random.Random(6)
    forms = list({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(200)})
    tree = canonical.BkTree(forms)
    for q in forms[:40]:
        assert sorted(tree.within(q, 2)) == sorted((d, f) for f in forms if (d := canonical.levenshtein(q, f)) <= 2)


def test_mapped_values(spark, monkeypatch):
    reference = spark.createDataFrame([("A", "Salgsleder", "Sales Lead", None), ("B", "Kundechef", "Customer Manager", None)], "code string, name string, a1 string, a2 string")
    rows = [(1, "Salgsleder"), (2, "salgs leder"), (3, "Chef for kunde"), (4, "Slagsleder hos X ApS"), (5, "Pilot"), (6, " "), (7, None), (8, "Kunde.chef"), (9, "Salgschef"), (10, "x" * 5000)]
    values = spark.createDataFrame([("s", i, v) for i, v in rows], "src string, rec_id long, value string")
    want = {2: "A", 3: "B", 4: "A", 5: "none", 8: "B", 9: "none", 10: "none"}
    for shard in (50_000, 1):
        monkeypatch.setattr(canonical, "SHARD", shard)
        got = {r.rec_id: r.ref_id for r in canonical.mapped_values(values, reference, "code", ["name", "a1", "a2"], "title").collect()}
        assert got == want


@pytest.mark.parametrize("text", ["Sønder Ærø – på å", "Blåbærgrød til små", "Får du svar? Spørg Ærø", "NØRRE STAVRRUP ÆBLE"])
@pytest.mark.parametrize("wrong,right", [("sloppy", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8")])
def test_round_trips(text, wrong, right):
    data = text.encode(right)
    bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if wrong == "sloppy" else data.decode(wrong)
    read = garbled.repair(bad)
    assert garbled.is_garbled(read[1], read[3]) and read[0] == text


@pytest.mark.parametrize("text", ["«Maison Élan» i Nørre", "São Vicente kaffe & te", "JOÃO", "Château Âme", "Łódź", "Сервис", "20°C", "5 µm", "½ pris på 3 m²", "Får du svar? Spørg", "Noerre Aaby", "", "https://x.dk/a?b=c"])
def test_correct_text_is_no_case(text):
    read = garbled.repair(text)
    assert not garbled.is_garbled(read[1], read[3]) and read[0] == text


def test_garbled_rows(spark):
    df = spark.createDataFrame([(1, "Ã¦ble"), (2, None), (3, "æble"), (4, ""), (5, "K?ge by"), (6, "BrÃƒÂ¦d")], "rec_id long, text string")
    got = {r.rec_id: (r.repaired, r.cost_after > 0) for r in garbled.repaired_values(df, "rec_id", {"t": F.col("text")}).collect()}
    assert got == {1: ("æble", False), 5: ("K?ge by", True), 6: ("Bræd", False)}


@pytest.mark.parametrize("text", ["{{title}} hos X", "[firmanavn]", "${a.b}", "X - undefined", "Lorem ipsum dolor sit amet", "Error 404", "Fejl 503: bad gateway", "JavaScript is required", "Untitled docoment", "Siden findes ikke", "Her kommer der snart tekst", "%s", "X | Access denied"])
def test_residue(text):
    assert residue.residue_kind(text)


@pytest.mark.parametrize("text", ["Sådan retter du fejl 404 i din webshop", "Rute 404 - bussen til X", "JavaScript-kursus for begyndere", "Mål dit vindue [B x H]", "Cookies og kager", "Null-fejl produktion", "Service 500 timer: det får du", "", None, "Ny sidemotor til haven"])
def test_content_is_no_residue(text):
    assert residue.residue_kind(text) is None


def test_unusable_rows(spark):
    df = spark.createDataFrame([(1, "h", "Error 404"), (1, "h", "Error 404"), (2, None, "Fin side"), (3, "h", None)], "analysis_id long, site_host string, title string")
    got = sorted((r.rec_id, r.field) for r in residue.unusable(df, "analysis_id", "site_host", {"title_text": F.col("title")}).collect())
    assert got == [(1, "title_text"), (1, "title_text")]


def test_person_forms():
    form = lambda n: variants.person_form(n)[0]
    assert form("Ravtand, Alexandra Humlevad") == form("ALEXANDRA HUMLEVAD RAVTAND") == form("Ing. alexandra  humlevad ravtand (barsel)")
    assert variants.person_form("Læs mere") is None and variants.person_form(None) is None and variants.person_form(" ") is None
    assert variants.person_cost("a||vesterville", "asger|drevkvist|vesterville", False) is not None
    assert variants.person_cost("asger||vesterville", "asger|drevkvist|vesterville", True) is None
    assert variants.firm_cost("knabannor byg.", "byggeri knabannor") is not None
    assert variants.firm_cost("holding x", "byg x") is None


def test_variant_entities(spark):
    rows = [(1, "f", "Rasmus Klintager"), (2, "f", "Rasmus Klintager"), (3, "f", "Ras Klintager"), (4, "f", "R. Klintager"), (5, "g", "Rasmus Klintager"), (6, "f", None), (7, "f", "Kontakt os"), (8, "f", "Rasmus Klintaegr")]
    rows += [(100 + i, f"h{i}", "Ulla Holm") for i in range(200)]
    df = spark.createDataFrame([(i, b, n, None, []) for i, b, n in rows], "rec_id long, block string, name string, number string, extra array<string>")
    pairs = {tuple(r) for r in variants.variant_pairs(variants.entities_of(df, "person")).collect()}
    assert pairs == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 8), (2, 8), (3, 8), (4, 8)}


def test_entity_cascade(spark):
    firms = [("60000001", "Lomibor Byg ApS", "By", "www.lomibor.example"), ("60000002", "Lomibor Holding ApS", "By", None), ("60000003", "Nuxefil VVS", "By C", ""), (None, "Uden Nummer", "By", "u.example")]
    firms += [(f"6100{i:04d}", f"{a} {t}", "Anden", None) for i, (a, t) in enumerate((f"{w.title()}zon", t) for w, t in zip(WORDS, ["Byg", "VVS", "Holding"] * 20, strict=True))]
    company = spark.createDataFrame(firms, "cvr string, name string, town string, site string")
    firm = entities.firms(company, "cvr", "name", "town", "site")
    cache = spark.createDataFrame([(1, "x", "https://lomibor.example/a", "Forside"), (2, "nuxefil", "https://side1.hotel.example", None), (3, "ukendt", "https://ukendt.example", "Ukendt Byg"), (4, None, None, None)], "cache_id long, normalized_key string, url string, title string")
    people = spark.createDataFrame([(7, "https://n.example/company/lomibor-holding-aps/about"), (8, "n.example/company/lomibor"), (9, None)], "profile_id long, company_url string")
    got = {(r.src, r.rec_id): (r.cvr, 0 < r.confidence <= 1) for r in entities.matched_entities(entities.pages(cache).unionByName(entities.profiles(people)), firm).collect()}
    assert got == {("url_cache", 1): ("60000001", True), ("url_cache", 2): ("60000003", True), ("profile", 7): ("60000002", True), ("profile", 8): ("60000001", True)}
