"""Personal data and secrets against plain versions."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from graphvec.llm import pii, secrets
from graphvec.llm.common import documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits(s)[::-1])) % 10 == 0


def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(m[0])]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


HARD = ["a@b.c_d@e.f", "x.@y.z..w", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1", "4111 1111 1111 1111", "5  4111-1111 1111-1111 9", "+1 (743) 555-3824 +1 4111 1111 1111 1111", "é😀 a%b@c-d.e-f 10.0.0.1", "0000000000000000 00000000000000000000", "+12 345 678 90.", "++1234567890+1(2)3456789", "mail a@b.c,d@e.f;g@h"]


def test_pii_base(docs, awkward):
    texts = awkward[:5] + awkward[10:] + HARD
    for r in pii.scan(docs(texts)).collect():
        wanted = plain_pii(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(wanted.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [wanted.count(f"{k}:") for k in pii.KINDS[:4]]


def test_pii_long_runs_end(docs, awkward):
    """Runs of tens of thousands of characters neither overflow the stack nor take quadratic time."""
    assert pii.scan(docs(awkward)).count() == len(awkward)
    assert pii.scan(docs([])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1 49.@+-_()%é", max_size=50), min_size=30, max_size=60))
def test_pii_random(docs, texts):
    for r in pii.scan(docs(texts)).collect():
        assert r["base_sha256"] == hashlib.sha256(plain_pii(texts[r["doc_id"]]).encode()).hexdigest(), texts[r["doc_id"]]


def test_disclosing_terms(docs):
    """A name that stands beside one address only, in several surroundings, discloses it; common words don't."""
    clean = [f"they wrote number {i} from home about the weather and the report says that everything is fine" for i in range(60)]
    months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    marked = [f"{m} Zebediah wrote from zeb@example.org about the report and the weather {m}" for m in months]
    texts = clean + marked + ["Yesterday Zebediah went home", None]
    out = {r["doc_id"]: r for r in pii.scan(docs(texts)).collect()}
    assert [out[i]["n_term"] for i in range(60)] == [0] * 60
    assert out[60]["spans"] == "term:8:16,email:28:43"
    assert out[60]["n_email"] == 1 and out[60]["base_sha256"] == hashlib.sha256(b"email:28:43").hexdigest()
    assert out[72]["spans"] == "term:10:18"
    clean_texts = {r["doc_id"]: r for r in pii.sanitise(docs(texts)).collect()}
    assert "[EMAIL]" in clean_texts[60]["text"] and "Zebediah" not in clean_texts[60]["text"]
    assert clean_texts[60]["n_chars"] == len(clean_texts[60]["text"])
    assert clean_texts[0]["text"] == clean[0] and clean_texts[73]["text"] is None


def test_disclosure_against_brute_force(docs):
    """Terms, shares and spans of a corpus of addresses, hosts and near copies, counted plainly."""
    import math
    import random
    from collections import Counter

    rng = random.Random(11)
    vocabulary = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    people = [("Zebediah", "zeb@one.org"), ("Ottoline", "ott@two.org"), ("Quentin", "q.x@two.org")]
    texts = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(30)]
        if i % 3 == 0:
            name, address = people[i // 3 % 3]
            w[12:12] = [name, "of", address]
        texts.append(" ".join(w))
    texts += [texts[0]] * 4 + ["Quentin " + t for t in texts[1:40:3]] + [None, ""]
    terms = lambda t: [x for x in re.split(r"[^a-zA-Z]+", t.lower()) if len(x) >= pii.LEAST_TERM]
    n_t = Counter(x for t in texts for x in terms(t or ""))
    total, n_c, places = sum(n_t.values()), Counter(), Counter()
    for t in texts:
        for m in EMAIL.finditer(t or ""):
            left = re.sub(r"^[a-zA-Z]+", "", t[m.start() - pii.REACH : m.start()]) if m.start() > pii.REACH else t[: m.start()]
            around = left + " | " + re.sub(r"(?<=.{%d})[a-zA-Z]+$" % (pii.REACH // 2), "", t[m.end() : m.end() + pii.REACH])
            for entity in (m[0].lower(), "@" + m[0].lower().split("@")[1]):
                n_c[entity] += 1
                places[entity, around] += 1
    n_ct, support = Counter(), Counter()
    for (entity, around), n in places.items():
        for x in set(terms(around)):
            n_ct[entity, x] += n
            support[entity, x] += 1
    wanted = {}
    for (entity, x), n in n_ct.items():
        share = 1 + math.log2((n + n_c[entity] / total) / (max(n_t[x], n) + 1)) / math.log2(total / n_c[entity])
        if support[entity, x] >= pii.SUPPORT and share >= pii.DISCLOSURE:
            wanted[x] = max(share, wanted.get(x, 0))
    plain = documents(docs(texts))
    got = {r["term"]: r["disclosure"] for r in pii.disclosing_terms(plain, pii.found_in(plain)).collect()}
    assert got == pytest.approx(wanted) and {"zebediah", "ottoline"} <= set(got) and "quentin" not in got
    for r in pii.scan(docs(texts)).collect():
        t = texts[r["doc_id"]] or ""
        base = [(m.start(), m.end()) for m in EMAIL.finditer(t)]
        spans = [(m.start(), m.end()) for m in re.finditer(r"[a-zA-Z]+", t) if m[0].lower() in wanted]
        spans = [x for x in spans if not any(x[0] < e and s < x[1] for s, e in base)]
        assert r["n_term"] == len(spans) and r["spans"] == ",".join([f"{k}:{s}:{e}" for s, e, k in sorted([(*x, "email") for x in base] + [(*x, "term") for x in spans])])


def test_sanitise_takes_any_columns(docs):
    table = docs(["mail a@b.cd", None, ""])
    for c in ("_mark", "_base", "base", "mark", "more", "row", "clean", "id", "m", "a.b"):
        table = table.withColumn(c, F.lit("x"))
    out = pii.sanitise(table)
    assert out.columns == table.columns and sorted(("-" if r["text"] is None else r["text"], r["a.b"]) for r in out.select("text", "`a.b`").collect()) == [("", "x"), ("-", "x"), ("mail [EMAIL]", "x")]


def test_sanitise_overlaps(docs):
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(["call +4 111 111 111 111 11 now", "ip 10.0.0.1, mail a@b.cd!", "", None])).collect()}
    assert "111" not in out[0] and out[0].startswith("call [") and out[0].endswith(" now")
    assert out[1] == "ip [IP], mail [EMAIL]!" and out[2] == "" and out[3] is None


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


SECRETS = ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "token=secret: abcdefghij", "Api_Key:'x' PASSWD=12345678", "AKIAAKIA AKIA234567890123 AKIA2345678901234", "f" * 31 + " " + "e" * 32, "paſsword=abcdefgh Key", "é password  ==abcdefgh secret='a.b/c+d=e-f_g'"]


def test_secrets_base(docs, awkward):
    texts = awkward + SECRETS
    out = {r["doc_id"]: r for r in secrets.scan(docs(texts), secrets.identifiers(docs(texts))).collect()}
    for i, t in enumerate(texts):
        wanted = plain_secrets(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(wanted.encode()).hexdigest(), t
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [wanted.count(f"{k}:") for k in ("assign", "access", "hex")]
    assert secrets.scan(docs([]), secrets.identifiers(docs([]))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokenTOKEN=: '\"secretapi_kyAKIA09abcdef.é", max_size=80))
def test_secrets_random(text):
    found = secrets.Scanner([]).base(text)
    assert ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found) == plain_secrets(text)


def test_novelty():
    known = ["authentication", "configuration", "session_handler", "load_user_settings_2", "customer_account_manager_1"] * 3
    scanner = secrets.Scanner(known)
    random_key, name = "q7Zr2LmX9vKd4TtB8nWcY1hP", "customer_account_manager_1"
    text = f"auth header {random_key} then session {name} end"
    spans = scanner.novel(text)
    assert [text[s:e] for s, _, e in spans] == [random_key]
    assert scanner.novel(f"no context at all here whatsoever, nothing of the kind it is {random_key}") == []
    a = text.index(random_key)
    assert scanner.novelty(text, a, a + len(random_key)) > scanner.novelty(text, text.index(name), text.index(name) + len(name))
    twice = f"token {random_key} and once more the token {random_key}"
    assert len(scanner.novel(twice)) == 2  # a repeated key does not make itself known


def test_novel_secrets_are_found(docs):
    """Planted keys that no base rule knows: precision and recall among names, paths and words that the corpus knows."""
    import random
    import string

    rng = random.Random(3)
    names = [f"{a}_{b}_{c}" for a in ("user", "order", "cache") for b in ("Session", "token", "Handler2") for c in ("Manager", "factory7", "loader")]
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts, wanted = [], set()
    for i in range(200):
        w = [rng.choice(names + ["private", "session", "return", "login(user)", "if", "key in cache:"]) for _ in range(40)]
        if i % 4 == 0:
            w.insert(20, f"bearer {draw(string.ascii_letters + string.digits, rng.choice([16, 24, 40]))} end")
        texts.append(" ".join(w))
        for m in re.finditer(r"bearer ([A-Za-z0-9]+) end", texts[-1]):
            wanted.add((i, m.start(1), m.end(1)))
    found = set()
    for r in secrets.scan(docs(texts), secrets.identifiers(docs(texts))).collect():
        found |= {(r["doc_id"], *map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("novel")}
        assert r["n_novel"] == r["spans"].count("novel:") and r["base_sha256"] == hashlib.sha256(plain_secrets(texts[r["doc_id"]]).encode()).hexdigest()
    assert len(found & wanted) >= 0.95 * len(wanted) and len(found & wanted) >= 0.95 * len(found)


@pytest.mark.parametrize("part,good", [("0", 1), ("255", 1), ("256", 0), ("000", 1), ("00099", 1), ("1000", 0)])
def test_ip_parts(docs, part, good):
    assert pii.scan(docs([f"{part}.1.1.1"])).first()["n_ip"] == good
