"""Secrets and personal data against plain regular expressions."""

import random
import re

import pytest

from passagelab.llm import pii, secret_scan
from tests.llm.odd import documents, empty, odd

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def private_by_hand(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))]
        return sum(doubled) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def noise(words, count, most=25, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(count)]


SECRET_BITS = ["token", "password", "api_key", "=", " ", ":", "'", '"', "secret", "AKIA", "ABCD1234EFGH56", "deadbeefdeadbeef", "a", "0", "é", "😀", "Passwd", "abcdefghijklmnop", "-", ".", "eyJ", "ghp_", "xoxb-", "\n"]
PRIVATE_BITS = ["a", "b.c", "@", ".", "example", ".org", " ", "-", "1", "23", "4111 1111 1111 1111", "192.168", "+", "49", "(0)", "555", "255.1", "é", "\n", "%", "_", "4111-1111", "00"]


def test_secrets_on_noise():
    scanner = secret_scan.scanner()
    order = {"assign": 0, "access": 1, "hex": 2}
    for text in noise(SECRET_BITS, 4000):
        assert [(a, order[r.kind], b) for a, b, r in scanner.scan(text) if r.base] == secrets_by_hand(text), text


@pytest.mark.parametrize("pattern", [r"a(b|c)*d", r"x{2,4}y?", r"[^a-c]+z", r"(ab?){1,2}", r"\.\x2dq|r"])
def test_automata_match_like_regular_expressions(pattern):
    rng = random.Random(1)
    tree = secret_scan.Parser(pattern).parse()
    ahead, back = secret_scan.compile_automaton({0: tree}, False), secret_scan.compile_automaton({0: secret_scan.reversed_tree(tree)}, False)
    for _ in range(500):
        text = "".join(rng.choice("abcdxyzqr.-") for _ in range(rng.randint(0, 8)))
        for automaton, data in ((ahead, text), (back, text[::-1])):
            state = automaton.start
            for byte in data.encode():
                state = automaton.rows[state][byte]
            assert bool(automaton.ends[state]) == bool(re.fullmatch(pattern, text))


def test_more_rules_add_spans():
    text = "key ghp_" + "a1B2" * 9 + " url https://me:pw@host -----BEGIN RSA PRIVATE KEY-----"
    assert [r.kind for _, _, r in secret_scan.scanner().scan(text)] == ["github", "url_login", "private_key"]


def test_private_data_on_noise():
    for text in noise(PRIVATE_BITS, 6000):
        assert pii.base_spans(text) == private_by_hand(text), text


@pytest.mark.parametrize("make", [documents, odd])
def test_tables(spark, make):
    docs = make(spark)
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    secrets = sorted((r.id is None, r.id or 0, [(s.start, s.end) for s in r.spans if s.base]) for r in secret_scan.spans_of(docs).collect())
    private = sorted((r.id is None, r.id or 0, [(s.start, s.end) for s in r.spans if s.base]) for r in pii.detect(docs).collect())
    by_hand = lambda f: sorted((n, i, [(a, b) for a, _, b in f(t)]) for n, i, t in texts)
    assert secrets == by_hand(secrets_by_hand) and private == by_hand(private_by_hand)


def test_empty_tables(spark):
    assert secret_scan.digest(empty(spark)).count() == 0
    assert pii.digest(empty(spark)).count() == 0


def test_digests(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "é token=abcdefghijkl"), (2, None)], "doc_id long, text string")
    one, two = sorted(secret_scan.digest(docs).collect())
    assert (one.n_assign, one.spans, one.base_sha256) == (1, "assign:2:20", hashlib.sha256(b"assign:2:20").hexdigest())
    assert (two.n_assign, two.spans, two.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"please write to user{k}@mail.example now or never, the rest is prose {k}") for k in range(40)]
    rows += [(100, "please write to odd-name7_at_home now or never"), (101, "a number 12345 in other words")]
    found = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3].spans.startswith("email:16:") and found[3].n_email == 1
    assert found[100].spans == "found_email:16:33" and found[100].n_email == 0
    assert found[101].spans == ""


def bootstrapped(texts, rounds=3, least_pattern=0.6, least_instance=0.8, support=5, damping=1.0):
    """The rounds by dictionaries: {pattern: (kind, confidence)}."""
    edges, known = set(), set()
    for text in texts:
        seeds = pii.base_spans(text)
        for a, kind, b in seeds:
            known.add((pii.normal(text[a:b]), pii.KINDS[kind]))
            edges |= {(pii.normal(text[a:b]), p) for p in pii.contexts(text, a, b)}
        for a, b in pii.candidates(text, pii._merged([(a, b) for a, _, b in seeds])):
            edges |= {(pii.normal(text[a:b]), p) for p in pii.contexts(text, a, b)}
    for _ in range(rounds):
        scored = {}
        for p in {p for _, p in edges}:
            around = {i for i, q in edges if q == p}
            shares = sorted((-len({i for i in around if (i, k) in known}), k) for k in pii.KINDS)
            # an instance without a kind and one with several count for each of them
            total = sum(max(1, sum((i, k) in known for k in pii.KINDS)) for i in around)
            fair = -shares[0][0] / (total + damping)
            if total >= support and fair >= least_pattern:
                scored[p] = (shares[0][1], round(fair, 9))
        doubt = {}
        for i, p in edges:
            if p in scored:
                kind, c = scored[p]
                doubt[i, kind] = doubt.get((i, kind), 1) * (1 - c)
        already = {i for i, _ in known}
        known |= {(i, k) for (i, k), d in doubt.items() if round(1 - d, 9) >= least_instance and i not in already}
    return scored


def contextual_rows():
    rows = []
    for k in range(30):
        rows.append((len(rows), f"please write to user{k}@mail{k % 7}.example now or never, the rest is prose {k}"))
        rows.append((len(rows), f"the server at 10.0.{k}.{k * 3} went down again, call +49 30 {1000000 + 7 * k} for help today"))
        rows.append((len(rows), f"room number {1000 + k} is on floor {k}, order a-{k}b please"))
    rows += [(len(rows), "please write to odd-name7_at_home now or never"), (len(rows) + 1, "the server at host7.internal went down again"), (len(rows) + 2, "call 030-55512x for help today, " + "x" * 500 + " call 040-99912y for help today")]
    rows += [(len(rows), "a number 12345 in other words"), (None, "please write to odd-name7_at_home now or never"), (3, "the server at host9.internal went down again")]
    return rows


def test_bootstrap_matches_brute_force(spark):
    rows = contextual_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = bootstrapped([t for _, t in rows])
    assert {r.pattern: (r.kind, r.confidence) for r in pii.bootstrap(frame.select("text")).collect()} == wanted and len(wanted) > 8
    found = sorted((r.id is None, r.id or 0, [(s.start, s.end, s.kind, s.base) for s in r.spans]) for r in pii.detect(frame).collect())
    assert found == sorted((i is None, i or 0, pii.find(t, wanted)) for i, t in rows)
    kinds = {k for *_, spans in found for _, _, k, _ in spans}
    assert {"found_email", "found_ip", "found_phone"} <= kinds
    joined = sorted((r.id is None, r.id or 0, [(s.start, s.end, s.kind, s.base) for s in r.spans]) for r in pii.detect(frame, most_patterns=0).collect())
    assert joined == found


def test_contexts_are_whole_words():
    long = "w" * 3000
    assert pii.contexts(f"a {long} x5@y {long} b", 3003, 3007)[:3] == [f"a {long} _", f"{long} _ {long}", f"_ {long} b"]
    assert pii.contexts("x5@y", 0, 4) == [] and pii.shape("Ab1-22@x") == "a9-9@a"


def test_long_digit_runs_are_quick():
    import time

    began = time.time()
    pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@")
    assert time.time() - began < 5
