"""Chat formatting by token-level assembly.

Each turn's text is escaped and encoded by itself; reserved ids beyond the vocabulary mark where turns begin and
end, so no text can produce them. The sequence of a conversation is its segments in order of turn;
the loss mask covers the texts of assistant turns and comes from prefix sums of the segments'
lengths. The output is a table of pieces of at most PIECE_IDS ids each, so a very long
conversation is neither one row nor held whole by a task.

The rendered form spells the reserved ids as control strings. A control string inside a
text gets a backslash after its first character and every backslash is doubled, which is reversible.

Order: turn (null last), then role, then text; repeated rows are turns of their own. Null role or text: empty.
A null conv_id is a conversation of its own. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wavelet import encoder

#: The control strings, in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[TURN]", "[/TURN]", "[TEXT]")
BOS, END, SYS, SYS_END, USER, USER_END, OUT, OTHER, OTHER_END, OTHER_TEXT = range(len(CONTROLS))
FRAME = {"system": (SYS, SYS_END), "user": (USER, USER_END), "assistant": (OUT, END)}
PIECE_IDS = 65_536
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    while (out := _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)) != text:
        text = out
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def assemble(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, piece, ids, loss: pieces of token sequences, loss as one byte per id."""
    rows = common.need(conversations, conv_id="long", turn="long", role="string", text="string").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(tokenizer)
        for pdf in batches:
            ids = [np.frombuffer(x, code.kind).astype("<u4").tobytes() for x in code([escape(t) for t in pdf["text"]])]
            names = [np.frombuffer(x, code.kind).astype("<u4").tobytes() if r not in FRAME else b"" for r, x in zip(pdf["role"], code([escape(r) for r in pdf["role"]]))]
            yield pdf.assign(conv_id=pdf["conv_id"].astype("Int64"), turn=pdf["turn"].astype("Int64"), ids=ids, name=names)

    rows = rows.mapInPandas(encode, "conv_id long, turn long, role string, text string, ids binary, name binary")
    rows = rows.repartition(common.parallelism(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.select("conv_id", "role", "ids", "name")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
        mark = [np.array([base + k], "<u4") for k in range(len(CONTROLS))]
        now, piece, held, size = object(), 0, [], 0

        def flush(key) -> pd.DataFrame:
            ids = np.concatenate([x for x, _ in held])
            # mask: +1 where a counted segment starts and -1 where it ends, by prefix sums of lengths, then summed up
            ends = np.cumsum([len(x) for x, _ in held])
            counted = np.array([c for _, c in held], bool)
            step = np.zeros(len(ids) + 1, np.int32)
            np.add.at(step, (ends - [len(x) for x, _ in held])[counted], 1)
            np.add.at(step, ends[counted], -1)
            loss = np.cumsum(step[:-1]).astype(np.uint8)
            return pd.DataFrame({"conv_id": pd.array([key], "Int64"), "piece": [piece], "ids": [ids.tobytes()], "loss": [loss.tobytes()]})

        for pdf in batches:
            for conv, role, ids, name in zip(pdf["conv_id"].astype("Int64"), pdf["role"], pdf["ids"], pdf["name"]):
                key = None if conv is pd.NA else conv
                if key != now:
                    if held:
                        yield flush(now)
                    now, piece, held, size = key, 0, [(mark[BOS], False)], 1
                start, end = FRAME.get(role, (OTHER, OTHER_END))
                parts = [(mark[start], False), (np.frombuffer(ids, "<u4"), role == "assistant"), (mark[end], False)]
                if role not in FRAME:
                    parts[1:1] = [(np.frombuffer(name, "<u4"), False), (mark[OTHER_TEXT], False)]
                for x, counted in parts:
                    for k in range(0, max(1, len(x)), PIECE_IDS):
                        held.append((x[k : k + PIECE_IDS], counted))
                        size += len(held[-1][0])
                        if size >= PIECE_IDS:
                            yield flush(now)
                            piece, held, size = piece + 1, [], 0
        if held:
            yield flush(now)

    return rows.mapInPandas(join, "conv_id long, piece int, ids binary, loss binary")


def digest(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """Reads the pieces back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = pieces.select("conv_id", "piece", "ids", "loss").repartition(common.parallelism(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = encoder(tokenizer).tokenizer
        base = decode.get_vocab_size(with_added_tokens=True)
        roles = {SYS: "system", USER: "user", OUT: "assistant"}
        now, state = object(), None

        def text_of(parts: list[np.ndarray]) -> str:
            return decode.decode(np.concatenate(parts).tolist(), skip_special_tokens=False) if parts else ""

        def done() -> dict:
            return {"conv_id": now, "n_turns": state["turns"], "turns_sha256": state["all"].hexdigest(), "loss_chars": state["loss"], "loss_sha256": state["own"].hexdigest(), "formatted_chars": state["chars"]}

        def frame(out: list[dict]) -> pd.DataFrame:
            got = pd.DataFrame(out)
            return got.assign(conv_id=got["conv_id"].astype("Int64"))

        def close(s: dict) -> None:
            raw = text_of(s["text"])
            s["chars"] += len(raw)
            plain = unescape(raw)
            s["all"].update(f"{s['role']}\n{plain}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(text_of(s["masked"]))
            s["own"].update(masked.encode("utf-8", "surrogatepass"))
            s["loss"] += len(masked)
            s["turns"] += 1

        for pdf in batches:
            out = []
            for conv, ids, loss in zip(pdf["conv_id"].astype("Int64"), pdf["ids"], pdf["loss"]):
                key = None if conv is pd.NA else conv
                if key != now:
                    if state:
                        out.append(done())
                    now = key
                    state = {"turns": 0, "all": hashlib.sha256(), "own": hashlib.sha256(), "loss": 0, "chars": 0, "text": [], "masked": [], "role": ""}
                ids, loss = np.frombuffer(ids, "<u4"), np.frombuffer(loss, np.uint8).astype(bool)
                at = 0
                for cut in [*np.flatnonzero(ids >= base), len(ids)]:
                    if cut > at:
                        state["text"].append(ids[at:cut])
                        if loss[at:cut].any():
                            state["masked"].append(ids[at:cut][loss[at:cut]])
                    if cut < len(ids):
                        control = int(ids[cut]) - base
                        state["chars"] += len(CONTROLS[control])
                        if control in (END, SYS_END, USER_END, OTHER_END):
                            close(state)
                        elif control == OTHER_TEXT:
                            raw = text_of(state["text"])
                            state["chars"] += len(raw)
                            state["role"] = unescape(raw)
                        elif control in roles:
                            state["role"] = roles[control]
                        if control != BOS:
                            state["text"], state["masked"] = [], []
                    at = cut + 1
            if out:
                yield frame(out)
        if state:
            yield frame([done()])

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
