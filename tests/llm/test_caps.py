"""No length, count or size cuts data off: p2, p7 and p9 on what such a cap would lose."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from stenbro.llm import canonical, garbled, leaks, residue

TITLES = [("A", ["Salgsleder", "Sales Lead"]), ("B", ["Kundechef"]), ("C", ["Salgsassistent"])]


def mapped(spark, values, entries=TITLES, kind="title"):
    reference = spark.createDataFrame([(k, f[0], f[1] if len(f) > 1 else None) for k, f in entries], "code string, name string, alias string")
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "src string, rec_id long, value string")
    return [r.ref_id for r in canonical.mapped_values(rows, reference, "code", ["name", "alias"], kind).orderBy("rec_id").collect()]


def test_p2_reads_every_part_of_a_headline(spark):
    extra = ["Far til tre", "Foredragsholder", "Cyklist", "Kaffe", "A/S", "X"]
    assert mapped(spark, [" | ".join([*extra[:n], "Salgsleder"]) for n in range(len(extra) + 1)][1:]) == ["A"] * len(extra)


@pytest.mark.parametrize("shard", [1, 2, 50_000])
def test_p2_gives_the_same_for_any_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(canonical, "SHARD", shard)
    values = ["Salg.r", "Kunde.f", "Salgsl.r", "Slagsleder", "Salgsledr | kundechef", "xyz", "salgs leder", "Kudnechef | salgsleeder"]
    entries = [*TITLES, ("D", ["Salgskonsulenter"])]
    assert mapped(spark, values, entries) == ["none", "B", "A", "A", "B", "none", "A", "B"]


def test_p2_tree_searches_many_forms_as_one_by_one():
    rng = random.Random(8)
    word = lambda lo, hi: "".join(rng.choice("abcdeæ") for _ in range(rng.randint(lo, hi)))
    tree = canonical.BkTree({word(3, 12) for _ in range(300)} | {"a" * 70, "ab" * 40})
    forms = [word(1, 14) for _ in range(150)] + ["a" * 69, "ab" * 40, "a" * 64, "z" * 64, ""]
    radii = [rng.randint(0, 4) for _ in forms]
    assert [sorted(x) for x in tree.within_all(forms, radii)] == [sorted(tree.within(f, r)) for f, r in zip(forms, radii, strict=True)]


@pytest.mark.parametrize("layers", range(1, 8))
def test_p7_takes_off_every_layer(layers):
    text = bad = "Blåbær på Ærø"
    for _ in range(layers):
        bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode())
    assert garbled.repair(bad)[0] == text


def found(documents, items):
    model = leaks.Items(list(range(len(items))), items, 1 / 3)
    texts, which, _ = leaks.found_in(model, documents)
    return set(zip(texts, which, strict=True))


def words(rng, n):
    return [f"ord{int(rng.random() ** 3 * 1500)}" for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 11, 12, 30])
def test_p9_finds_items_of_any_length(n):
    rng = random.Random(n)
    item = [f"kun{i}" for i in range(n)]
    part = item[: -(-n // 3)]
    noise = [f"andet{i}" for i in range(60)]
    documents = [" ".join(noise + item + noise), " ".join(item), " ".join(part), " ".join(words(rng, 50))]
    assert found(documents, [" ".join(item)]) == {(0, 0), (1, 0), (2, 0)}


@pytest.mark.parametrize("length,rate,least", [(8, 0.2, 0.97), (60, 0.0, 1.0), (60, 0.2, 0.97), (120, 0.1, 0.98), (120, 0.3, 0.9), (400, 0.2, 0.97)])
def test_p9_recall_by_edits(length, rate, least):
    """Share of what the alignment of everything finds, where `rate` of the words are changed, left out or added to."""
    rng = random.Random(5)
    items = [" ".join(words(rng, length)) for _ in range(40)]
    model = leaks.Items(list(range(40)), items, 1 / 3)
    documents, own = [], []
    for k in range(120):
        taken, n = items[k % 40].split(), int(length * rng.choice((0.4, 0.6, 1))) + 1
        at, part = rng.randint(0, max(0, length - n)), []
        for w in taken[at : at + n]:
            x = rng.random()
            part += words(rng, 1) if x < rate / 3 else [] if x < 2 * rate / 3 else [w, *words(rng, 1)] if x < rate else [w]
        documents.append(" ".join(words(rng, 60) + part + words(rng, 60)))
        own.append(k % 40)
    xs = [np.array([model.vocabulary[w] for w in leaks.words_of(d)], np.int32) for d in documents]
    n = leaks.matched([model.words[i] for i in own], xs)
    want = {(k, i) for k, i in enumerate(own) if n[k] >= model.asked[i]}
    texts, which, _ = leaks.found_in(model, documents)
    assert len(want & set(zip(texts, which, strict=True))) >= least * len(want)


def test_p9_blocks_of_items_and_long_tags(spark, monkeypatch):
    rng = random.Random(9)
    items = [" ".join(words(rng, 40)) for _ in range(9)]
    texts = [(i, items[i]) for i in range(9)] + [(50, "<a href='" + "x" * 500 + "'>" + items[0] + "</a>"), (51, None), (52, "")]
    a = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items), (90, None)], "item_id long, passage string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(a, b, "doc_id", "text", "item_id", "passage").collect()}
    assert got == {(i, i) for i in range(9)} | {(50, 0)}


SPOKEN_OF = [
    "Kursus i placeholder text og HTML", "Sådan bruger du snake_case i Python", "Lys_grå maling", "Artikel: hvad betyder siden findes ikke?",
    "Coming soon: vores nye butik i Aarhus åbner", "God stil: undgå undefined variable i JavaScript",
]


def test_p6_keeps_what_only_speaks_of_messages(spark):
    """Content amid many hosts' messages stays; a message amid other words goes where its frame stands on two hosts."""
    rows = [(i, "egen.example", t) for i, t in enumerate(SPOKEN_OF)]
    rows += [(100 + i, f"h{i}.example", t) for i, t in enumerate(["Siden findes ikke", "Coming soon", "undefined", "Tagdækning i {{by}}", "Error 404", "Placeholder text"] * 3)]
    rows += [(200, "a.example", "Her er en ny side hos Lomibor: siden findes ikke i arkivet"), (201, "b.example", "Her er en ny side hos Nuxefil: siden findes ikke i arkivet"), (202, "c.example", "Tagdækning i undefined"), (203, "d.example", "Error 404 Lomibor Tag")]
    df = spark.createDataFrame(rows, "analysis_id long, site_host string, title string")
    got = {r.rec_id for r in residue.unusable(df, "analysis_id", "site_host", {"title_text": F.col("title")}).collect()}
    assert got == {i for i, _, _ in rows if i >= 100}


def test_p6_groups_across_fields_and_hosts(spark):
    rows = [(1, "a", "Error 404", "Error 500", None), (2, "b", "Fin side", "Error 404", "timeout"), (3, None, None, " ", "Content")]
    df = spark.createDataFrame(rows, "analysis_id long, site_host string, title string, text string, status string")
    fields = {"title_text": F.col("title"), "meta_description": F.col("text"), "render_status": F.col("status")}
    values, groups = residue.messages(df, "analysis_id", "site_host", fields)
    assert {(r.example, r.fields, r.n_rows, r.n_hosts) for r in groups.collect()} == {("Error 404", "meta_description,title_text", 3, 2), ("timeout", "render_status", 1, 1)}
    assert values.count() == 6
    got = {(r.rec_id, r.field) for r in residue.unusable(df, "analysis_id", "site_host", fields).collect()}
    assert got == {(1, "title_text"), (1, "meta_description"), (2, "meta_description"), (2, "render_status")}
