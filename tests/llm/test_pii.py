import re

from wirelake.llm import pii

TEXTS = [
    "mail a.b@x.org or a@b or @x.y and z@q.w.e.",
    "ips 1.2.3.4.5 256.1.1.1 10.0.0.255 1.2.3 001.002.003.004",
    "cards 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111222233334444",
    "phone +1 (555) 123-4567, +12, +1 234 567 890 123 456 7 and ++49 30 123456",
    "é a@é.com x y@z.io@w.co",
    "",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
]


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans():
    assert pii.base_spans("0" * 6000 + ".1.1.1") == [("ip", 0, 6006)]
    for t in [*TEXTS, " ".join(TEXTS), "\n".join(TEXTS * 50)]:
        assert pii.base_spans(t) == brute(t)


def corpus():
    rows = [(i, f"plain words number w{i} about the weather and the sea") for i in range(60)]
    rows += [(100 + i, f"note {i}: nightingale writes to bird@sky.org about the sea") for i in range(5)]
    rows += [(200, "Nightingale sang"), (201, None), (202, ""), (None, "call +1 (555) 123-4567 now")]
    return rows


def test_disclosing_terms(docs_of, clash):
    """The term that stands only beside one address is found, wherever it stands; common ones are not."""
    docs = clash(docs_of(corpus()))
    terms = {r["term"]: r for r in pii.disclosing_terms(docs).collect()}
    assert "nightingale" in terms and not {"the", "sea", "about"} & set(terms)
    # brute force of its disclosure
    import math

    n, pair, entity, df = 69, 5, 5, 6
    assert abs(terms["nightingale"]["disclosure"] - math.log2(pair * n / entity / df) / -math.log2(entity / n)) < 1e-9
    found = {r["doc_id"]: r for r in pii.find_pii(docs, pii.disclosing_terms(docs)).collect()}
    assert len(found) == 69 and [(t["start"], t["end"]) for t in found[200]["terms"]] == [(0, 11)]
    assert found[100]["base"] == "email:30:42" and found[201]["base"] == "" and found[None]["n_phone"] == 1
    assert found[3]["terms"] == [] and found[201]["sanitised"] is None


def test_sanitise(docs_of, clash):
    got = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(clash(docs_of(corpus()))).collect()}
    assert "bird@sky.org" not in got[100] and "[EMAIL]" in got[100] and "nightingale" not in got[100].lower()
    assert "ightingale" not in got[200] and got[201] is None and got[3] == corpus()[3][1]
    assert got[None] == "call [PHONE] now"


def test_empty(docs_of):
    docs = docs_of([])
    assert pii.find_pii(docs, pii.disclosing_terms(docs)).count() == 0


def test_terms_of_rare_entities(docs_of):
    """A term that stands only in texts with some address is found, though each address stands in one text and far off."""
    far = " ".join(f"filler{k}" for k in range(60))
    rows = [(i, f"plain words number w{i} about the sea {far}") for i in range(60)]
    rows += [(100 + i, f"Subscriber of the sea {far} bird{i}@sky.org") for i in range(4)]
    rows += [(200 + i, f"lonely whale {far} one@x.org") for i in range(2)]
    docs = docs_of(rows)
    terms = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert "subscriber" in terms and not {"the", "sea", "filler1", "whale", "sky", "org"} & terms


def test_repeated_ids_and_parts(spark, docs_of, monkeypatch):
    """Rows that share an id keep their own spans; terms broadcast in many parts give what one part gives; very long texts are read whole."""
    rows = [*corpus(), (1, "nothing here"), (1, "mail c@d.org or nightingale"), (1, "mail c@d.org or nightingale"), (5, "sea " * 50_000 + "end@of.text")]
    docs = docs_of(rows)
    terms = pii.disclosing_terms(docs)
    whole = sorted(tuple(map(str, r)) for r in pii.find_pii(docs, terms).collect())
    got = sorted(r["sanitised"] or "" for r in pii.find_pii(docs, terms).where("doc_id = 1").collect())
    assert got[0] == got[1] == "mail [EMAIL] or [WORD]" and got[2] == "nothing here"
    assert any(r["base"] == "email:200000:211" or r["base"] == "email:200000:200011" for r in pii.find_pii(docs, terms).where("doc_id = 5").collect())
    monkeypatch.setattr(pii, "TERMS", 1)
    more = terms.unionByName(spark.createDataFrame([("weather", 0.9, "generalise"), ("sea", 0.9, "remove")], terms.schema))
    split = pii.find_pii(docs, more)
    monkeypatch.setattr(pii, "TERMS", 1000)
    assert sorted(tuple(map(str, r)) for r in split.collect()) == sorted(tuple(map(str, r)) for r in pii.find_pii(docs, more).collect()) != whole


def test_terms_are_cut_before_they_are_folded():
    assert pii.term_set("in İstanbul, ẞ1 o'Neil") == {"in", "İstanbul".lower(), "ß1", "o'neil"}
    assert [m[0].lower() for m in pii.TERM.finditer("in İstanbul, ẞ1 o'Neil")] == ["in", "İstanbul".lower(), "ß1", "o'neil"]
