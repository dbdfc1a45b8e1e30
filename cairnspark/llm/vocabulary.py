"""Vocabularies of byte-level BPE: loading, merging, and the proof of whole tokens."""

from __future__ import annotations

import base64
import json
from functools import cache



def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in json vocabularies: Latin-1's visible signs stand for themselves, the rest follow from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_json(path: str) -> tuple[dict[bytes, int], list[str]]:
    """(ranks, special strings) of a byte-level BPE in the json format.

    Ids must rise with the order of the merges, so that they serve as ranks;
    a vocabulary for which they don't is refused.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec["added_tokens"]]
    model, back = spec["model"], byte_alphabet()
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without a prefix space is read here")
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids don't follow the order of the merges")
    return ranks, special


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merges the pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def prove_whole(ranks: dict[bytes, int]) -> tuple[set[bytes], dict[bytes, list[bytes]]]:
    """(strings that alone encode as one token, the merges of those that don't), by merging every string of the vocabulary."""
    whole, broken = set(), {}
    for token in ranks:
        parts = merge(token, ranks)
        if len(parts) == 1:
            whole.add(token)
        else:
            broken[token] = parts
    return whole, broken


def merger(ranks: dict[bytes, int]):
    """The compiled merger: bytes of one pre-token to ids."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
