"""Secret scan and personal data against plain expressions."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pii, secret_scan
from graphloom.llm._io import sha256_text, span_text
from graphloom.llm.secret_scan import RULES, Rule, query_trigrams, scan_batch, trigram_query


def satisfied(query, text):
    kind = query[0]
    if kind == "all":
        return True
    if kind == "tri":
        return query[1] in text
    return (all if kind == "and" else any)(satisfied(q, text) for q in query[1])


def test_queries():
    assert trigram_query(r"AKIA[A-Z0-9]+") == ("and", (("tri", "aki"), ("tri", "kia")))
    assert trigram_query(r"[0-9a-f]+") == ("all",)
    assert trigram_query(r"abc|xyz") in (("or", (("tri", "abc"), ("tri", "xyz"))), ("or", (("tri", "xyz"), ("tri", "abc"))))
    assert trigram_query(r"(abc)?") == ("all",)
    assert "tok" in query_trigrams(trigram_query(secret_scan.ASSIGN))


@pytest.mark.parametrize("pattern", [r"ab(c|de)f+g", r"(foo|ba[rz])[0-9]{2}qux", r"x?yz{1,3}abc", r"a.c.e", r"(ab|cd){2}ef", r"[ab][cd]e(fg)*h"])
@settings(deadline=None, max_examples=60)
@given(st.data())
def test_queries_hold_for_every_match(pattern, data):
    assert satisfied(trigram_query(pattern), data.draw(st.from_regex(pattern)))


PIECES = st.sampled_from(["password", "PassWd", "secret", "Token", "api_key", "APIKEY", " = ", ":", '"', "'", "abcdef12", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", " ", "\n", "é", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJabcdefgh.", "sk_live_0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefgh", "toKen=abcdefgh"])


def plain(text, rules):
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
    return sorted(out)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=9).map("".join)), min_size=1, max_size=5))
def test_index_finds_what_a_full_scan_finds(texts):
    assert scan_batch(pa.array(texts, pa.string()), RULES) == [plain(t or "", RULES) for t in texts]


def test_secret_digests(spark):
    rows = [(1, 'a token = "abcdef123" b', "x"), (1, 'a token = "abcdef123" b', "x"), (2, None, "y"), (None, "AKIA" + "A" * 16, "z"), (3, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = sorted(((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.secret_digests(df).collect()))
    assert len(found) == 5 and found[1] == found[2] == (1, 1, 0, 0, sha256_text("assign:2:20"), "assign:2:20")
    assert found[0][1:] == (0, 1, 0, sha256_text("access:0:20"), "access:0:20")
    assert found[3] == (2, 0, 0, 0, sha256_text(""), "") and found[4][0] == 3
    spans = secret_scan.secret_spans(df.withColumnRenamed("doc_id", "my id"), "my id").collect()
    assert sum(len(r.spans) for r in spans) == 3
    assert secret_scan.secret_digests(df.limit(0)).count() == 0


def test_own_rules(spark):
    df = spark.createDataFrame([(1, "id-77 id-8")], "doc_id long, text string")
    assert [s.kind for s in secret_scan.secret_spans(df, rules=[Rule("badge", r"id-[0-9]+", least=5)]).first().spans] == ["badge"]


# --- personal data -------------------------------------------------------------------


BITS = st.sampled_from(["a.b+c", "@", "mail.example.com", "x@y", ".", "..", "12", "255", "256", "000001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "(", "-", " ", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "ssn ", "card ", "é", "9" * 30])


def plain_pii(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PATTERNS[kind], text):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
                "iban": kind == "iban" and 15 <= len(v.replace(" ", "")) <= 34 and pii.mod97(v.replace(" ", "")),
                "ssn": not set(text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]) & set("0123456789-"),
            }[kind]
            score = pii.score(text, kind, *m.span())
            if ok and (kind in pii.BASE_KINDS or score >= pii.KEEP):
                out.append((m.start(), k, m.end(), score))
    return sorted(out)


@settings(deadline=None, max_examples=300)
@given(st.lists(BITS, max_size=9).map("".join))
def test_linear_forms_equal_the_expressions(text):
    assert pii.find(text) == plain_pii(text)
    assert pii._found(pa.array([text, None]))[0] == plain_pii(text)


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_context_moves_the_score():
    bare = pii.find("x 123-45-6789 y")
    assert bare == []
    (start, k, end, score) = pii.find("social security 123-45-6789")[0]
    assert pii.KINDS[k] == "ssn" and score == pii.PRIOR["ssn"] + pii.RAISE
    assert pii.find("version 1.2.3.4")[0][3] == pii.PRIOR["ip"] - pii.LOWER
    assert pii.find("ip 1.2.3.4")[0][3] == pii.PRIOR["ip"] + pii.RAISE


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a." * 100_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.find(text)


def test_pii_digests_and_redaction(spark):
    rows = [(1, "mail a@b.co now", "keep"), (1, "mail a@b.co now", "keep"), (2, None, None), (None, "call +1 555 123 4567", "k"), (4, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {(r.doc_id, r.n_email, r.n_phone, r.spans) for r in pii.pii_digests(df).collect()}
    assert found == {(1, 1, 0, "email:5:11"), (2, 0, 0, ""), (None, 0, 1, "phone:5:20"), (4, 0, 0, "")}
    assert pii.pii_digests(df).count() == 5 and pii.pii_digests(df.limit(0)).count() == 0
    clean = pii.redact_pii(df.select("spans", "text", "doc_id"))
    assert clean.columns == ["spans", "text", "doc_id"]
    assert sorted((r.text or "", r.doc_id or 0) for r in clean.collect()) == [("", 2), ("", 4), ("call <PHONE>", 0), ("mail <EMAIL> now", 1), ("mail <EMAIL> now", 1)]
    assert sum(r.text is None for r in clean.collect()) == 1
    assert span_text([(0, 1, 3), (5, 0, 9)], ["a", "b"]) == "b:0:3,a:5:9"


@pytest.mark.parametrize("sizes", [(20, 251, 43), (36, 900, 342), (260, 300, 400)])
def test_long_web_tokens_are_whole(sizes):
    parts = ["eyJ" + "a" * sizes[0], "b" * sizes[1], "c" * sizes[2]]
    token = ".".join(parts)
    kind = [r.kind for r in RULES].index("jwt")
    found = scan_batch(pa.array([f"x {token} y"]), RULES)[0]
    assert (2, kind, 2 + len(token)) in found
