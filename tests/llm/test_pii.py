import pathlib
import re

import numpy as np
import pytest
from conftest import rows_of

from eventloom.llm import pii as P

# labelled by hand; none of these sentences is in the table that the recogniser learns from
HELD_OUT = [
    ("The pump is fine. My number is 020 7946 0999, please send a new one. It arrived late.", {("phone", "020 7946 0999")}),
    ("Sturdy strap; call me on (512) 555-0188 after six.\nSerial SN82031281 is on the back.", {("phone", "(512) 555-0188")}),
    ("Bitte unter 0176 04069012 zurückrufen. Seriennummer 42/555-8457 steht hinten.", {("phone", "0176 04069012")}),
    ("Rappelez-moi au 06.39.98.11.22. Version 3.7.9.22 installée.", {("phone", "06.39.98.11.22")}),
    ("Llámenme al +34 555 01 07 55. Pedido 938 3135 25, pagué £11.", {("phone", "+34 555 01 07 55")}),
    ("My social security no. QQ 12 34 56 C was printed on the slip! Part 4671-774-6116 is the spare clip.", {("id_number", "QQ 12 34 56 C")}),
    ("Patient id number: 951-77-2048. The sticker says model 951-77-2049.", {("id_number", "951-77-2048")}),
    ("Sogar meine Ausweisnummer L0G421687 stand auf dem Paket. Bestellung A1185351, bezahlt £76.", {("id_number", "L0G421687")}),
    ("On m'a demandé mon numéro de sécu, 9 12 13 99 111 222 33 ! C'est plutôt fragile.", {("id_number", "9 12 13 99 111 222 33")}),
    ("El documento X0012345B salía en la etiqueta. Mide 70 x 277 mm.", {("id_number", "X0012345B")}),
    ("Questions? saskia.wexlova (at) example.org It was set up by the store at 20:07 on 2022-12-27.", {("email", "saskia.wexlova (at) example.org")}),
    ("I left my address (tomas-brelick81@post.example.net) and nobody replied.", {("email", "tomas-brelick81@post.example.net")}),
    ("Meine Adresse hedda_stav@home.invalid wurde ignoriert. Maße: 3 x 169 mm.", {("email", "hedda_stav@home.invalid")}),
    ("Send the refund form to jorun [at] mail [dot] example, not to my old inbox.", {("email", "jorun [at] mail [dot] example")}),
    ("It was left outside 88 N. Juniper Road, Apt 4C in the rain.", {("address", "88 N. Juniper Road, Apt 4C")}),
    ("The van stopped at PO Box 911 instead of ours. It took 80 Road Trips to the Bramley store.", {("address", "PO Box 911")}),
    ("Bitte liefern an Lindenweg 7b. Steht jetzt in der Diele.", {("address", "Lindenweg 7b")}),
    ("Merci de livrer au 12 bis, rue du Moulin. Il faut 5 piles.", {("address", "12 bis, rue du Moulin")}),
    ("Vivo en Calle Alameda nº 9, segundo piso. Lleva 396 pilas.", {("address", "Calle Alameda nº 9")}),
    ("Thanks to Priya Nestowski for the quick help. Marlow Finch calls it the Keix mode.", {("name", "Priya Nestowski")}),
    ("Nurse Goran T. Quinova showed us the settings.", {("name", "Goran T. Quinova")}),
    ("The account is under Ilvard, Ulla. Will it last? Grace period was 3 days.", {("name", "Ilvard, Ulla")}),
    ("Laut Frau Elspeth Thollin dauert es noch. Nie wieder Quillon.", {("name", "Elspeth Thollin")}),
    ("Gracias a Mirek Olbez por la ayuda. Quillon me convenció.", {("name", "Mirek Olbez")}),
    ("I would buy the Nimix Mini 339 again without thinking. Order no. 3364-538-9690 came in 8 parcels; meet me @ the counter of Hallow & Reed.", set()),
    ("The Rose Quartz colour is nice. In May the sensor stopped blinking. @deal_hunter_9 v9.13.0.9 10.0.163.1", set()),
    ("色は白です。重さは202グラムです。電池は143本必要です。", set()), ("Настроил за 213 минут, но нужно 18 батарейки. Цена 1 562,00 kr.", set()), ("", set()), ("   \n ", set()),
]


@pytest.fixture(scope="module")
def field(spark, table):
    return P.recogniser_field(table("person_names"), table("items"))


def found(field, texts):
    return [{(k, t[a:b]) for a, b, k in s} for t, s in zip(texts, P.Recogniser(field).spans(texts))]


def test_held_out_accuracy(field):
    texts = [t for t, _ in HELD_OUT]
    got = found(field, texts)
    want = [w for _, w in HELD_OUT]
    hit, all_, extra = sum(len(g & w) for g, w in zip(got, want)), sum(map(len, want)), sum(len(g - w) for g, w in zip(got, want))
    assert hit >= 0.9 * all_ and extra <= 1, [(g, w) for g, w in zip(got, want) if g != w]


def test_other_wording(field):
    """Sentences none of whose wording is in the labelled table or the documents. Settings were
    chosen with a view to them, so the shares are those of a development set."""
    span = re.compile(r"\[(email|phone|id_number|address|name|code)\|((?:[^\[\]]|\[(?:at|dot)\])*)\]")
    hit = all_ = extra = 0
    for line in (pathlib.Path(__file__).parent / "carriers.txt").read_text(encoding="utf-8").splitlines():
        want = {(m[1], m[2]) for m in span.finditer(line) if m[1] != "code"}
        got = found(field, [span.sub(lambda m: m[2], line)])[0]
        hit, all_, extra = hit + len(got & want), all_ + len(want), extra + len(got - want)
    assert hit >= 0.75 * all_ and extra <= 0.05 * (hit + extra), (hit, all_, extra)


def test_same_tables_same_model(field, table):
    again = P.train(sorted({r["name"] for r in table("person_names").collect() if r["kind"] == "given"}), sorted({r["name"] for r in table("person_names").collect() if r["kind"] == "family"}), sorted({r["brand"] for r in table("items").collect()}), sorted({r["item_name"] for r in table("items").collect()}))
    assert np.allclose(again.w, field.w, atol=1e-4)


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(1)
    t, start = np.where(P._allowed(), r.normal(0, 1, (11, 11)), -1e4), np.where([x[0] == "I" for x in P.TAGS], -1e4, 0.0)
    e = r.normal(0, 2, (3, 4, 11))
    size = np.array([4, 3, 1])
    got = P.viterbi(e, size, t, start)
    for i in range(3):
        score = lambda p, i=i: start[p[0]] + sum(e[i, j, x] for j, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(11), repeat=int(size[i])), key=score)
        assert score(tuple(got[i, : size[i]])) == pytest.approx(score(best))
    # gradients: expected counts against all paths
    m, pairs = P._marginals(e[:, :3], np.minimum(size, 3), t, start)
    w = {p: np.exp(start[p[0]] + sum(e[1, j, x] for j, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(11), repeat=3)}
    z = sum(w.values())
    assert m[1, 1, 3] == pytest.approx(sum(v for p, v in w.items() if p[1] == 3) / z)


def test_windows_overlap(field):
    filler = "The pump is fine and the strap is light. "
    texts = [filler * k + "Call me on (512) 555-0188 after six. " + filler * 40 for k in range(0, 24)]
    assert all(("phone", "(512) 555-0188") in f for f in found(field, texts))


def test_tables(spark, table):
    text = "Thanks to Priya Nestowski for the quick help.\n Call me on (512) 555-0188 after six. Call me on (512) 555-0188 after six."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "fine " * 60_000 + text)], "doc_id long, text string").selectExpr("*", "1 as kind", "2 as found", "3 as _k")
    names, items = table("person_names"), table("items")
    want = [(i, k, f) for i in (1, 4) for k, f in (("name", "Priya Nestowski"), ("phone", "(512) 555-0188"))]
    assert rows_of(P.personal_information(docs, names, items), "doc_id", "kind", "found") == want
    masked = {r["doc_id"]: r["text"] for r in P.without_personal_information(docs, names, items).collect()}
    assert masked[1] == "Thanks to [NAME] for the quick help.\n Call me on [PHONE] after six. Call me on [PHONE] after six." and masked[2] is None and masked[3] == ""
    assert P.personal_information(docs.limit(0), names, items).count() == 0


def test_large_tables_are_refused(spark, table, monkeypatch):
    monkeypatch.setattr(P, "GAZETTEER", 3)
    with pytest.raises(ValueError, match="more than 3 rows"):
        P.recogniser_field(table("person_names"), table("items"))
