import random

import corpus_pipeline as C

ENGLISH = "the of and to in that was with for his on as they were which from have this not but there when said would been could house water little good people right about never after again thing long great world every young".split()
GERMAN = "der und die in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über haben ihre schule wasser zwischen geschichte".split()
FINNISH = "ja on ei se että hän oli mutta niin kuin ovat joka sitten kaikki vielä täällä yksi kaksi kolme ihminen talossa yöllä päivällä hyvää huomenta kiitos paljon mitä kuuluu minulle sinulle meidän kylässä järven rannalla".split()
POLISH = "w i na że się nie do jest z to jak po ale przez był tylko już może wszystko człowiek książka wieczór dzień dobry dziękuję proszę szkoła między chłopiec dziewczyna przyszedł powiedział źródło świat życie".split()


def test_noise_and_languages_that_nobody_taught_are_rejected(spark, documents):
    rng = random.Random(9)

    def of(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    def letters(n, some="abcdefghijklmnopqrstuvwxyz"):
        return " ".join("".join(rng.choice(some) for _ in range(rng.randint(2, 9))) for _ in range(n))

    good = [(i, of(words, rng.choice([15, 60, 300])), lang) for i, (words, lang) in enumerate([(ENGLISH, "en"), (GERMAN, "de")] * 90)]
    bad = [t for n in (60, 300, 1500) for t in (letters(n), letters(n, "bcdfghklmnpqrstvwxz"), of(FINNISH, n), of(POLISH, n))]
    docs = documents(good + [(1000 + i, t, None) for i, t in enumerate(bad)])
    assert {r.doc_id for r in C.language(spark, docs, "").collect()} == {i for i, *_ in good}
