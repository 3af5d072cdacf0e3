import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import sanitise
from tallyframe.llm.queries import op3_sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOC = "doc_id long, text string, base string, spans string"


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=list("0123.+-() @ab15é\n"), max_size=60))
def test_base_spans(text):
    assert sanitise.base_spans(text) == brute(text)


def test_counts_per_kind(spark, tmp_path):
    texts = ["a@b.co c@d.co +1 234 567 8901", "10.0.0.1 and 10.0.0.2, 4111 1111 1111 1111", "+1 234 567 8901 +1 234 567 8902 a@b.co", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_sanitise(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        want = brute(text or "")
        assert [got[i][f"n_{k}"] for k in sanitise.KINDS[:4]] == [sum(s[1] == k for s in want) for k in range(4)], i
        spelt = ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["spans"] == spelt and got[i]["base_sha256"] == hashlib.sha256(spelt.encode()).hexdigest()


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        sanitise.base_spans(text)


def test_disclosing_terms_found_and_others_left(spark):
    rnd = random.Random(3)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(10)]
    data = []
    for i in range(400):
        words = [rnd.choice(vocab) for _ in range(30)]
        if i % 20 == 0:  # the code name stands near one address, in texts of their own
            words[10:10] = ["Zanzibar", "jo@example.com"]
        data.append((i, " ".join(words), "x", "y"))
    data += [(1000 + i, "copied unusual wording near 10.1.2.3 address", "x", "y") for i in range(50)]
    got = {r["doc_id"]: r for r in sanitise.disclosures(spark.createDataFrame(data, DOC)).collect()}
    for i, text, *_ in data:
        terms = {text[t["start"]:t["end"]].lower() for t in got[i]["terms"]}
        assert terms == ({"zanzibar"} if "Zanzibar" in text else set()), (i, terms)
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(spark.createDataFrame(data, DOC)).collect()}
    assert "Zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and "[WORD]" in clean[0]
    assert clean[1] == data[1][1] and "[IP]" in clean[1000]


def test_strong_pairs_of_one_or_two_documents(spark):
    rnd = random.Random(5)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(10)]
    some = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    data = [(i, some(40), "x", "y") for i in range(400)]
    # ten mentions in each of two documents that begin with one templated line
    data += [(1000 + i, "Contact: jo@example.com " + " ".join(f"{some(12)} Zanzibar jo@example.com" for _ in range(10)), "x", "y") for i in range(2)]
    # ten mentions in one document; copies of a document with one mention; one mention of a rare word; a repeated address
    data += [(2000, " ".join(f"{some(12)} Kalamata al@example.com" for _ in range(10)), "x", "y")]
    data += [(3000 + i, f"{data[0][1]} Ljubljana mo@example.com", "x", "y") for i in range(9)]
    data += [(4000, f"{some(9)} Reykjavik bo@example.com bo@example.com bo@example.com", "x", "y")]
    terms = {}
    for r in sanitise.disclosures(spark.createDataFrame(data, DOC)).collect():
        text = next(t for i, t, *_ in data if i == r["doc_id"])
        terms[r["doc_id"]] = {text[t["start"]:t["end"]] for t in r["terms"]}
    assert {i: t for i, t in terms.items() if t} == {1000: {"Zanzibar"}, 1001: {"Zanzibar"}, 2000: {"Kalamata"}}


def test_every_word_counts_for_one_mention():
    text = "one a@b.co two a@b.co three"
    got = sanitise.mentions(text, sanitise.base_spans(text))
    assert len(got) == 1 and got[0][2] == len(got[0][3]) == 4 and got[0][4] == []  # three words and their class


def test_nulls_repeats_empty(spark):
    data = [(1, None, "a", "b"), (None, "", "a", "b"), (2, "a@b.co", "a", "b"), (2, "a@b.co", "a", "b"), (2, "+1 234 567 8901", "a", "b")]
    df = spark.createDataFrame(data, DOC)
    assert sorted(len(r["base"]) for r in sanitise.disclosures(df).collect()) == [0, 0, 1, 1, 1]
    out = sanitise.sanitise(df)
    assert out.columns == df.columns
    assert sorted(map(str, (r["text"] for r in out.collect()))) == ["", "None", "[EMAIL]", "[EMAIL]", "[PHONE]"]
    assert sanitise.sanitise(spark.createDataFrame([], DOC)).count() == 0


def test_redaction_of_overlaps():
    assert sanitise.redact("ab 12 cd", [(0, 4, 2), (3, 2, 5), (3, 3, 4)], set()) == "[WORD] [CARD] cd"
    assert sanitise.redact("ab cd", [(0, 4, 2)], {0}) == " cd"


def copies_with_edits(rnd, n, edits, contact):
    base = [f"{rnd.choice('bdfgklmnprstvz')}{rnd.choice('aeiou')}{rnd.choice('bdfgklmnprst')}{k:02}" for k in range(18)]
    base = ["".join(c if c.isalpha() else "abcdefghij"[int(c)] for c in w) for w in base]
    out = []
    for i in range(n):
        words = list(base)
        for k in range(edits):
            words[rnd.randrange(18)] = "edit" + "".join(rnd.choice("abcdefghij") for _ in range(6))
        words.insert(9, contact)
        out.append(" ".join(words))
    return out


def test_near_copies_are_one_piece_of_evidence(spark):
    rnd = random.Random(9)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(10)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    data = [" ".join(some(40)) for _ in range(400)]
    for edits, contact in ((1, "ed@example.com"), (2, "mo@example.com"), (1, "+1 555 867 5309")):
        data += copies_with_edits(rnd, 40, edits, contact)
    planted = [" ".join(some(9) + ["Zanzibar", "jo@example.org"] + some(12)) for _ in range(20)]
    planted += [" ".join(some(12) + ["10.1.2.3", "host", "Kalamata"] + some(7)) for _ in range(12)]
    data += planted
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(data)], DOC)
    got = sanitise.disclosures(docs).collect()
    for r in got:
        text = data[r["doc_id"]]
        told = {text[t["start"]:t["end"]] for t in r["terms"]}
        assert told == {w for w in ("Zanzibar", "Kalamata", "host") if w in text.split()}, (r["doc_id"], told)


def brute_terms(texts, threshold=0.7, alpha=0.01):
    """The disclosing terms by the definition, over dictionaries of all documents."""
    import math
    from collections import defaultdict
    n = len(texts)
    n_t, n_e, near, contexts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(dict)
    for text in texts:
        spans = sanitise.base_spans(text)
        seen = {w.lower() for w in sanitise.WORD.findall(text)}
        for w in seen:
            n_t[w] += 1
        for c in ("WORD", "NUMBER"):
            n_t["[" + c] += any(sanitise.term_class(w) == c or c == "WORD" for w in seen)
        words, free, said = sanitise.words_outside(text, spans), defaultdict(int), defaultdict(set)
        for s in spans:
            e = sanitise.entity(text, s)
            left, right = sum(w[0] < s[0] for w in words), sum(w[0] < s[2] for w in words)
            a = [w[2] for w in words[max(free[e], left - sanitise.WINDOW):left]]
            b = [w[2] for w in words[max(free[e], right):right + sanitise.WINDOW]]
            free[e] = max(free[e], min(right + sanitise.WINDOW, len(words)))
            said[e] |= {*a, *b} | {"[" + sanitise.term_class(w) for w in a + b}
            if a or b:
                contexts[e][tuple(a + b)] = {tuple(x[k:k + sanitise.RUN]) for x in (a, b) for k in range(len(x) - sanitise.RUN + 1)}
        for e, terms in said.items():
            n_e[e] += 1
            for t in terms:
                near[t, e] += 1
    holds, w = defaultdict(set), {}
    for e, cs in contexts.items():
        root = {c: c for c in cs}
        changed = True
        while changed:
            changed = False
            for c in cs:
                for d in cs:
                    if cs[c] & cs[d] and root[c] != root[d]:
                        root[c] = root[d] = min(root[c], root[d])
                        changed = True
        w[e] = len(set(root.values()))
        for c in cs:
            for t in {*c} | {"[" + sanitise.term_class(x) for x in c}:
                holds[t, e].add(root[c])
    limit, out = math.log(max(len(near), 1) / alpha), set()
    for (t, e), k in near.items():
        p, q, ic = n_t[t] / n, len(holds[t, e]) / w[e], math.log(n / n_e[e])
        if p >= 1 or q <= p or ic <= 0:
            continue
        bound = w[e] * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))
        if bound > limit and math.log(n * k / (n_t[t] * n_e[e])) / ic >= threshold:
            out.add(t)
    return {t for t in out if t[0] != "["}


def test_terms_match_the_definition(spark):
    rnd = random.Random(21)
    vocab = [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(4)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    texts = []
    for i in range(300):
        words = some(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(8)
            at = rnd.randint(0, len(words))
            words[at:at] = [f"u{k}@example.com"] + ([f"code{chr(97 + k)}"] if rnd.random() < 0.8 and k < 5 else [])
        texts.append(" ".join(words))
    texts += copies_with_edits(rnd, 20, 1, "u1@example.com")
    want = brute_terms(texts)
    got = set()
    for r in sanitise.disclosures(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOC)).collect():
        got |= {texts[r["doc_id"]][t["start"]:t["end"]].lower() for t in r["terms"]}
    assert got == want and want >= {"codea"}
