"""The trial's measures against plain Python on texts that hold all that is counted."""

import random
import re
import statistics as st

from corpusloom.operators import trial

TEXTS = [
    None, "", "   \n\n ", "One two.", "---\nt: x\n---\nI saw it; \"we\" (you) said: see http://a.b — or not -- perhaps... It may be 12 or 3!? Moreover, it's walked.\n\nAnd they were happily handed over. But \"then\" was wanted. So what? Yet it's worth noting: in addition, in some sense.",
    "word " * 99 + "Word.", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(257)) + ". Rather quickly, seemingly! My own… “quote” <!-- gone --> I suspect they are being helped.",
]


def plain(text):
    t = re.sub(r"\A---.*?---", "", re.sub(r"<!--.*?-->", "", text or "", flags=re.S), flags=re.S).replace("’", "'").replace("‘", "'").strip()
    words = lambda x: re.findall(trial.WORD, x)
    ss = [s for s in re.split(trial.SENTENCE_END, re.sub(r"\s+", " ", t)) if s.strip()]
    ws, low = words(t), t.lower()
    k = 1000 / max(1, len(ws))
    sl = [len(words(s)) for s in ss] or [0]
    n_p = max(1, len([p for p in t.split("\n\n") if p.strip()]))
    lw = [w.lower() for w in ws]
    wins = [len(set(lw[i : i + 100])) / 100 for i in range(0, len(lw) - 99, 10)]
    out = {
        "sentence_length_mean": st.mean(sl), "sentence_length_sd": st.pstdev(sl), "short_sentence_share": sum(x < 8 for x in sl) / len(sl), "long_sentence_share": sum(x > 28 for x in sl) / len(sl),
        "sentences_per_paragraph": len(ss) / n_p, "words_per_paragraph": max(1, len(ws)) / n_p, "commas_per_sentence": t.count(",") / max(1, len(ss)),
        "conjunction_opener_share": sum((words(s) or [""])[0].lower() in ("and", "but", "so", "or", "yet", "then") for s in ss) / max(1, len(ss)),
        "type_token_mattr": st.mean(wins) if wins else len(set(lw)) / max(1, len(lw)), "word_length_mean": st.mean(map(len, ws)) if ws else 0, "long_word_share": sum(len(w) >= 7 for w in ws) / max(1, len(ws)),
    }
    out |= {f"{n}_per_1k": len(re.findall(p.replace("(?U)", ""), t)) * k for n, p in trial.SIGNS.items()}
    out["quotes_per_1k"] /= 2
    out |= {f"{n}_per_1k": len(re.findall(rf"\b(?:{'|'.join(v)})\b", low)) * k for n, v in {**trial.PERSONS, "hedges": trial.HEDGES, "formal_connectives": trial.FORMAL}.items()}
    return out | {f"{n}_per_1k": len(re.findall(p, low)) * k for n, p in trial.PATTERNS.items()}


def test_measures(spark):
    got = {r["key"]: r.asDict() for r in trial.metrics(spark.createDataFrame(list(enumerate(TEXTS)), "key int, text string")).collect()}
    for key, text in enumerate(TEXTS):
        want = plain(text)
        assert len(want) == 28 and {k: round(v, 5) for k, v in want.items()} == {k: round(v, 5) for k, v in got[key].items() if k != "key"}, key
    assert all(any(r[k] for r in got.values()) for k in plain("x"))  # each of them is met


def test_windows_slide():
    words = [f"w{k * k % 37}" for k in range(1000)]
    for window, step in ((100, 10), (7, 1), (1000, 10), (1001, 3)):
        whole = [len(set(words[i : i + window])) / window for i in range(0, len(words) - window + 1, step)] or [len(set(words)) / 1000]
        assert abs(trial.moving_ttr(words, window, step) - st.mean(whole)) < 1e-12


def test_moving_share_is_the_mean_of_shares():
    r = random.Random(5)
    apart = 0
    for _ in range(300):
        words = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(9)) for _ in range(r.randint(100, 500))]
        sizes = [len(set(words[i : i + 100])) for i in range(0, len(words) - 99, 10)]
        total = 0.0
        for n in sizes:
            total += n / 100
        assert trial.moving_ttr(words) == total / len(sizes)
        apart += total / len(sizes) != sum(sizes) / len(sizes) / 100
    assert apart
