import hashlib
import re

import pytest

from terraloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "", "x", "a@b.c d@e f@g.h.i@j.k", "@@a.b @x.y a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (511) 555-6887 +1 +12345678901234567 ++1234567890", "mail a.b%c@host.org, ip 10.0.0.1!", "é 4003036626649762 日本 +49 (30) 1234-5678", "1" * 500 + "." + "2" * 30, "a" * 3000 + "@b.cc",
    "7536784127813050 4845168114407329", "+1((((((((((", "٣.٣.٣.٣",
]


def plain(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m.group())]
    return sorted(found, key=lambda x: (x[1], list(PLAIN).index(x[0])))


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_trees_generalise_to_held_out_rows():
    x, y = pii.constructed()
    held = [i % 4 == 0 for i in range(len(y))]
    model = pii.Boosted().fit(x[[not h for h in held]], y[[not h for h in held]]).calibrate(x[held], y[held])
    assert ((model.score(x[held]) >= 0.5) == y[held]).mean() > 0.9
    assert set(model.thresholds) == set(pii.KINDS)


def test_find(odd, make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)])
    model = pii.train(docs)
    for r in pii.find(docs, model).collect():
        base = plain(TEXTS[r.doc_id])
        join = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(join.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert set(join.split(",")) - {""} <= set(r.spans.split(","))
        masks = sum(r.redacted.count(f"[{k.upper()}]") for k in pii.KINDS)
        outside = len(r.redacted) - sum(r.redacted.count(f"[{k.upper()}]") * (len(k) + 2) for k in pii.KINDS)
        assert bool(masks) == bool(r.spans) and outside <= len(TEXTS[r.doc_id]) - len({i for _, a, b in base for i in range(a, b)})
    assert pii.find(odd, model).count() == 8
    assert pii.find(odd.limit(0), pii.train(odd.limit(0))).count() == 0


def test_candidates_add_written_forms():
    model = pii.Boosted().fit(*pii.constructed()).calibrate(*pii.constructed())
    spans = pii.all_spans("please call (511) 555-6887 today", model)
    assert spans == [("phone", 12, 26)]
    assert pii.all_spans("the order 2024-01-15 of it", model) == []
    assert pii.redact("call (511) 555-6887 now", [("phone", 5, 19)]) == "call [PHONE] now"


def test_every_separator_proposes_its_address():
    text = "mail a@b.org or bob [at] c.net"
    assert [text[a:b] for k, a, b in pii.candidates(text) if k == "email"] == ["a@b.org", "bob [at] c.net"]
    model = pii.Boosted().fit(*pii.constructed()).calibrate(*pii.constructed())
    assert [text[a:b] for _, a, b in pii.all_spans(text, model)] == ["a@b.org", "bob [at] c.net"]
    names = ["ann [at] one.net", "ben(at)two.org", "cay at three dot com", "dan ( @ ) four [dot] net", "eve@five.org"]
    text = "write to " + ", ".join(names) + " or look at at six.org"
    assert [text[a:b] for k, a, b in pii.candidates(text) if k == "email"] == [*names, "at at six.org"]
