import hashlib
import re

from plumbline.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    spans, counts = [], [0] * 4
    for rank, (kind, pattern) in enumerate(BASE):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(part) <= 255 for part in match[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                spans.append((match.start(), rank, f"{kind}:{match.start()}:{match.end()}"))
                counts[rank] += 1
    joined = ",".join(span for *_, span in sorted(spans))
    return *counts, hashlib.sha256(joined.encode()).hexdigest()


def base(row):
    return row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256


HARD = [
    "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "x@y@z.com +1 (22) 333-4444 55", "4111 1111 1111 1111 22",
    "é😀 a@b.co 4111-1111-1111-1111", "+1+12345678901", "..@a.b", "1-2-3--4", "+12 34567 890 ", "999.1.1.1 1.1.1.1",
    "1" * 5000 + "@" + "a." * 5000, "a@b.c-d.e@f.g", "1.1.1.1.", "%@a.b.c@d.e", "a" * 3000 + " 4" + " 4" * 3000, "007.008.0255.1",
    "9.9.9.9@9.9.9.9 +99999999999999999", None, "",
]


def test_hard_texts(documents):
    rows = list(enumerate(HARD))
    found = {r.doc_id: base(r) for r in pii.find(documents(rows, clashing=True)).collect()}
    assert found == {i: brute(text) for i, text in rows}


def test_given_documents_agree_with_brute_force(table):
    docs = table("documents", "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = pii.find(docs).collect()
    assert {r.doc_id: base(r) for r in found} == {i: brute(text) for i, text in texts.items()}
    for row in found:
        spans = [span.split(":") for span in row.spans.split(",") if span]
        assert len(spans) == row.n_email + row.n_ip + row.n_card + row.n_phone + row.n_discovered


def test_odd_rows(odd_documents):
    found = pii.find(odd_documents).collect()
    assert sorted(map(base, found)) == sorted(brute(r.text) for r in odd_documents.collect())


def test_context_discovers_unseen_identifiers(documents):
    rows = [(i, f"please call phone: +1 (2{i:02d}) 555-7{i:03d} tomorrow") for i in range(30)]
    rows += [(100, "please call phone: 555-7441 tomorrow"), (101, "see room 555-7441b tomorrow"), (102, "order 5557441 of page 12345")]
    found = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    text = dict(rows)[100]
    at = text.index("555")
    assert found[100].spans == f"phone:{at}:{at + 8}" and found[100].n_discovered == 1 and found[100].n_phone == 0
    assert found[102].spans == "" and found[102].n_discovered == 0
    assert all(found[i].n_phone == 1 and found[i].n_discovered == 0 for i in range(30))


def test_mixed_contexts_discover_nothing(documents):
    kinds = ["a.b@c.de", "10.20.30.40", "4111111111111111", "+1 (222) 555-7777", "x99999"]
    rows = [(i, f"see {kinds[i % 5].replace('9', str(i % 10))} there") for i in range(50)]
    assert sum(r.n_discovered for r in pii.find(documents(rows)).collect()) == 0


def test_empty_table(documents):
    assert pii.find(documents([])).collect() == []
