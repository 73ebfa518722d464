import hashlib
import random

from huskwatch.llm import chat


def brute(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", " [/INST] ", "\\", "<<SYS>>", "<", "/s>", "[", "é😀", "\n", "ok", "<</SYS>>", "$0"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool</s>", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])))
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (99, None, "user", "n"), (99, 5, "assistant", "z" * 200_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", segment int").repartition(4)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(turns).collect()}
    assert got == brute(rows)
    assert all(s["segment"].count("</s>") == 1 and s["segment"].count("[INST]") == 1 for s in chat.segments(turns).collect())


def test_examples_hold_all_turns_before_and_one_reply(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} <s>") for t in range(2500)]
    formatted = chat.segments(spark.createDataFrame(rows, SCHEMA))
    whole = "".join(r["segment"] for r in formatted.orderBy("place").collect())
    found = chat.examples(formatted).orderBy("example").collect()
    assert len(found) == 1250
    for r in found:
        assert chat.unescape(whole[r["target_start"]:r["target_end"]]) == f"text {r['example'] - 1} <s>"
        assert whole[:r["length"]].count("[/INST]") == r["example"]
    short = formatted.where("place <= 6")
    for r in chat.expand(short, chat.examples(short)).collect():
        assert r["text"] == whole[:len(r["text"])] and chat.unescape(r["text"][r["target_start"]:r["target_end"]]) == f"text {r['example'] - 1} <s>"


def test_probe_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digest(empty).collect() == []
    text = "</s>[INST] ok [/INST]"
    r = chat.digest(chat.with_probe(empty)).first()
    assert (r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (-7, 2, len(text), hashlib.sha256(text.encode()).hexdigest())
