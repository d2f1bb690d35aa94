"""Sentence runs and surrogates against plain Python."""
import random
import re

from crestline.llm import sentence_dedup as S, surrogates as P


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 14))).capitalize() + rng.choice([". ", ".\n", "! ", "? "])
    passage = "".join(sentence() for _ in range(8))
    out = ["".join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(60)]
    for i in range(0, 60, 4):
        half = len(out[i]) // 2
        out[i] = out[i][:half] + " " + passage + out[i][half:]
    return out + out[:5] + [passage, passage + passage]


def test_sentences_join_to_the_text():
    for text in [*_texts(), "", "no end", "a. b", "\n\n x.\n\ny", "Dr. X said \"no.\" Then… yes!?  ok\n"]:
        assert "".join(S.sentences(text)) == text


def test_sentence_dedup(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(500 + i, r.text) for i, r in enumerate(odd_docs.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    first, found = {}, []
    for key, text in sorted(rows, key=lambda r: r[0]):
        for a, b, mark in S.runs(S.sentences(text or "")):
            found.append((key, a, b, mark))
            first.setdefault(mark, (key, a))
    drop = {}
    for key, a, b, mark in found:
        if first[mark] != (key, a):
            drop.setdefault(key, set()).update(range(a, b))
    want = {k: None if t is None else "".join(p for i, p in enumerate(S.sentences(t)) if i not in drop.get(k, ())) for k, t in rows}
    assert len(drop) > 15
    assert {r.doc_id: r.text for r in S.deduplicate(df).collect()} == want
    assert S.deduplicate(no_docs).count() == 0
    assert S.deduplicate(odd_docs).count() == odd_docs.count()


def _all_runs(parts):
    """All runs of two sentences and 20 words at least, as (first, end, words)."""
    full = [i for i, p in enumerate(parts) if p.split()]
    for a in range(len(full)):
        for b in range(a + 2, len(full) + 1):
            words = " | ".join(" ".join(parts[i].lower().split()) for i in full[a:b])
            if len(words.replace(" | ", " ").split()) >= 20:
                yield full[a], full[b - 1] + 1, words


def test_every_sentence_of_a_repeated_run_goes(spark):
    rng, number = random.Random(8), iter(range(10**6))
    sentence = lambda n: " ".join(f"w{next(number)}" for _ in range(n)).capitalize() + ". "
    passages = [[sentence(n) for n in sizes] for sizes in ([15, 10, 4], [4, 10, 15], [3, 30, 2, 2, 1], [1, 1, 18, 1], [9, 9, 9, 9, 1, 1])]
    rows = []
    for i in range(40):
        body = [sentence(rng.randint(1, 15)) for _ in range(rng.randint(0, 4))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            body += p + [sentence(rng.randint(1, 15))]
        rows.append((i, "".join(body)))
    first, drop = {}, {}
    for key, text in rows:
        for a, b, words in _all_runs(S.sentences(text)):
            if first.setdefault(words, (key, a)) != (key, a):
                drop.setdefault(key, set()).update(range(a, b))
    want = {k: "".join(p for i, p in enumerate(S.sentences(t)) if i not in drop.get(k, ())) for k, t in rows}
    assert len(drop) > 15
    assert {r.doc_id: r.text for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want


PEOPLE = ["Mail anna.b7@mail.example.com or ANNA.B7@mail.example.com now.", "Call +1 (342) 555-8390. Call +1 (342) 555-8390!", "ip 57.14.248.132, card 4315726095712222.",
          "Frau Weber met Herr Weber and Mrs. Jane Smith; Господин Иванов не пришёл.", "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00", "again anna.b7@mail.example.com",
          "nothing here: 1.2.3 or 2024-01-02 or 12345", "x" * 20000 + "@" + "y" * 20000]


def _luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 % 10 + d // 5 for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark, odd_docs, no_docs):
    rows = list(enumerate(PEOPLE))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in P.replace(df, "key").collect()}
    texts = [got[i].text for i in range(len(PEOPLE))]
    assert [got[i].n_entities for i in range(len(PEOPLE))] == [2, 2, 2, 4, 2, 1, 0, 0]
    assert texts[6:] == PEOPLE[6:]
    one, two = re.findall(r"\S+@\S+", texts[0])
    assert one != two and re.fullmatch(r"[a-z]{4}\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.com", one) and re.fullmatch(r"[A-Z]{4}\.[A-Z]\d@[a-z]{4}\.[a-z]{7}\.com", two)
    assert one in texts[5] and one.split("@")[1] == two.split("@")[1]
    a, b = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", texts[1])
    assert a == b and a not in PEOPLE[1]
    assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+, card \d{16}\.", texts[2]) and _luhn(texts[2][-17:-1]) and "57.14" not in texts[2]
    m = re.fullmatch(r"Frau (\w+) met Herr (\w+) and Mrs\. (\w+) (\w+); Господин ([А-я]+) не пришёл\.", texts[3])
    assert m and m[3] in P.GIVEN["f", "latin"] and "Weber" not in texts[3] and "Иванов" not in texts[3]
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} iban DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", texts[4])
    assert {r.doc_id: r.text for r in P.replace(df, "key").collect()} == {i: t for i, t in enumerate(texts)}
    assert P.replace(df, "other").where("doc_id = 0").first().text != texts[0]
    assert P.replace(no_docs, "key").count() == 0
    odd = P.replace(odd_docs, "key")
    assert odd.count() == odd_docs.count() and odd.where("text IS NULL").count() == 1


def test_collisions_draw_again(spark):
    """All 254^0 numbers of a tiny format: with two digits' worth of room, surrogates still differ from each other."""
    cards = [(f"{4000000000000000 + i}",) for i in range(200)]
    names = [("Frau " + chr(65 + i) + chr(97 + j),) for i in range(20) for j in range(20)]
    got = P.surrogates(spark.createDataFrame(cards + names, "entity string"), "k").collect()
    assert len({r.surrogate for r in got}) == len(got) == 600
    assert not {r.surrogate for r in got} & {r.entity for r in got}


def test_mentions_of_one_identity(spark):
    rows = ["Mr. John Smith|Mr. Smith|Mr Smith|Mr. Paul Smith|MR|Mr. SMITH", "Mrs Smith|Mrs. Smith|Mrs. Jane Smith's", "Ann.B@X.com|ann.b@x.com", "+1 (342) 555-8390|+1-342-555-8390|+13425558390",
            "4315726095712222|4315 7260 9571 2222|4315-7260-9571-2222", "DE89 3704 0044 0532 0130 00|DE89370400440532013000", "Господин Пётр Иванов|Господин Иванов"]
    df = spark.createDataFrame([(i, " ; ".join(r.split("|"))) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text.split(" ; ") for r in P.replace(df, "key").collect()}
    m, w, mail, phone, card, iban, cyrillic = (got[i] for i in range(len(rows)))
    family = m[1].split()[-1]
    assert family != "Smith" and m[0].split()[-1] == m[3].split()[-1] == family and m[2] == f"Mr {family}" and m[5] == f"Mr. {family.upper()}"
    assert m[0].split()[1] != m[3].split()[1] and not {"John", "Paul"} & {m[0].split()[1], m[3].split()[1]} - set(P.GIVEN["m", "latin"])
    assert w[0] == "Mrs " + w[1].split()[-1] and w[2].split()[-1] == w[1].split()[-1] + "'s"
    assert mail[0].lower() == mail[1] != "ann.b@x.com" and mail[0][0].isupper() and "@" in mail[0]
    for forms, before in ((phone, rows[3]), (card, rows[4]), (iban, rows[5])):
        assert len({re.sub(r"\W", "", f) for f in forms}) == 1 and not set(forms) & set(before.split("|"))
        assert [re.sub(r"\w", "", f) for f in forms] == [re.sub(r"\w", "", f) for f in before.split("|")]
    assert phone[2].startswith("+1") and _luhn(card[0]) and iban[0].startswith("DE")
    assert cyrillic[0].split()[-1] == cyrillic[1].split()[-1] != "Иванов"


def test_whole_names_and_untitled_mentions(spark):
    rows = ["Mr. John Paul Smith left. Later Smith's friend met John, and Smith-led talks began.", "Mr. J. Smith and Mr. J. K. O'Neil; O'Neil said so.", "Prof. Dr. Anna von Weber-Stein; Dr. Kowalski",
            "Smith has no title here.", "Mr. " + " ".join(f"N{chr(97 + i)}xq" for i in range(12)) + " went", "Mr. Smith I think is SMITH, not a smith. Smithson stays.", "Frau Ö. Weber, Herr Weber's"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in P.replace(df, "key").collect()}
    texts = [got[i].text for i in range(len(rows))]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) (\w+) left\. Later (\w+)'s friend met (\w+), and (\w+)-led talks began\.", texts[0])
    assert m and m[3] == m[4] == m[6] != "Smith" and m[1] == m[5] != "John" and m[2] != "Paul" and got[0].n_entities == 4
    m2 = re.fullmatch(r"Mr\. ([A-Z])\. (\w+) and Mr\. ([A-Z])\. ([A-Z])\. (\w+); (\w+) said so\.", texts[1])
    assert m2 and m2[2] == m[3] and m2[1] == m2[3] != "J" and m2[4] not in ("K", m2[3]) and m2[5] == m2[6]
    m3 = re.fullmatch(r"Prof\. Dr\. (\w+) von (\w+); Dr\. (\w+)", texts[2])
    assert m3 and m3[1] != "Anna" and m3[2] != "Weber" and m3[3] != "Kowalski"
    assert texts[3] == rows[3] and not re.search("N[a-z]xq", texts[4]) and len(texts[4].split()) == 14
    assert texts[5] == f"Mr. {m[3]} I think is {m[3].upper()}, not a smith. Smithson stays."
    assert re.fullmatch(r"Frau [^Ö]\. (\w+), Herr \1's", texts[6])
