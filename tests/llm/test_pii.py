import random
import re
import time

from trackloom.llm import pii

from .helpers import AWKWARD, documents

TEXTS = [
    "mail a.b+c@ex-ample.co.uk, or x@y.z@w.v and a@b-c.d_e@f.gh.",
    "@no.local a@b a@b. é@é.fr éa@b.cd",
    "ip 1.2.3.4 and 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 99999999999999999999999.1.1.1",
    "card 4337166598464399, 4337 1665-9846 4399, 4337166598464398. 1 2 3 4337166598464399",
    "tel +1 (988) 555-2485, +49.30.1234567890 +12 +1234567890123456 ++44 20 7946 0958)",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE89370400440532013001",
    "my ssn is 123-45-6789 while this other number of an order 123-45-6780 has nothing near it",
    "\U0001f600 café a@b.cd \U0001f600 +1 (988) 555-2485",
    "1" * 30000,
    "a" * 30000 + "@" + "b." * 10000 + "c",
]
ROWS = [*AWKWARD, *enumerate(TEXTS, 100)]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_spans_equal_the_plain_patterns(spark):
    got = pii.find_pii(documents(spark, ROWS, extra=True)).collect()
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        text = texts[r["doc_id"]] or ""
        for kind, pattern in BASE.items():
            if len(text) > 20000 and kind == "email":
                want = [(0, len(text))] if "@" in text else []
            else:
                want = [m.span() for m in re.finditer(pattern, text) if holds(kind, m[0])]
            assert [(s["start"], s["end"]) for s in r[kind]] == want, (kind, text[:80])
            assert all(s["text"] == text[s["start"] : s["end"]] for s in r[kind])


def test_checksums_and_context(spark):
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, ROWS)).collect()}
    assert [s["text"] for s in got[105]["iban"]] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [s["text"] for s in got[106]["ssn"]] == ["123-45-6789"]
    assert got[103]["card"][0]["score"] == 1.0 and got[104]["phone"][0]["score"] == 0.8


def test_masking_and_empty_table(spark):
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(documents(spark, ROWS)).collect()}
    assert got[107] == "\U0001f600 café [EMAIL] \U0001f600 [PHONE]" and got[1] == ""
    assert pii.find_pii(documents(spark, [])).count() == 0


def plain_score(kind, text, start, end):
    base, checked, near = pii.SCORES[kind]
    around = text[max(0, start - 40) : start] + " " + text[end : end + 40]
    return round(min(1.0, base + checked + (near if re.search(pii.CONTEXT[kind], around) else 0.0)), 6)


def test_many_matches_in_one_long_text(spark):
    """Positions, context and masking of 200,000 matches; spans of one kind by the plain pattern."""
    rng = random.Random(3)
    parts = [rng.choice(["1.2.3.4 ", "host 9.8.7.6 ", "é\U0001f600 ", "no 300.1.1.1 ", "call +1 (988) 555-2485, ", "word " * 9]) for _ in range(40_000)]
    rows = [(1, "1.2.3.4 " * 200_000), (2, "".join(parts)), (3, "".join(parts[:70]))]
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, rows)).collect()}
    assert time.monotonic() - begun < 60
    assert [s["start"] for s in got[1]["ip"]] == list(range(0, 1_600_000, 8))
    for doc in (2, 3):
        text = dict(rows)[doc]
        for kind in ("ip", "phone"):
            want = [(*m.span(), plain_score(kind, text, *m.span())) for m in re.finditer(BASE[kind], text) if holds(kind, m[0])]
            assert [(s["start"], s["end"], s["score"]) for s in got[doc][kind]] == want
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(documents(spark, rows)).collect()}
    assert masked[1] == "[IP] " * 200_000
    for doc in (2, 3):
        text, at, out = dict(rows)[doc], 0, []
        for s, e, k in sorted((s["start"], s["end"], s["kind"]) for k in pii.PATTERNS for s in got[doc][k]):
            if s >= at:
                out.append(text[at:s] + f"[{k.upper()}]")
            at = max(at, e)
        assert masked[doc] == "".join(out) + text[at:]
