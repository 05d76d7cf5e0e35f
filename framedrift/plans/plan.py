"""The plan: an ordered list of steps with a type, a probability and parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from framedrift.functions.frames import CHECKSUM_WAYS

# Step names and their aliases as plans spell them.
STEP_NAMES = {
    "loss": "loss",
    "retransmit": "retransmit",
    "retrans": "retransmit",
    "reorder": "reorder",
    "jitter": "reorder",
    "rate_modify": "rate_modify",
    "seq_offset": "seq_offset",
    "length_forge": "length_forge",
}
CONTENT_STEPS = ("seq_offset", "length_forge")
COPYING_STEPS = ("retransmit", "rate_modify")
REORDER_METHODS = ("blocks", "greedy")
DEFAULT_SEGMENT = 5
DEFAULT_OFFSET = 1000

CUSTOM_STEPS: dict[str, Callable[..., DataFrame]] = {}
ROW_STEPS: dict[str, tuple[Callable, bool]] = {}


@dataclass(frozen=True)
class Step:
    """One step; ``number`` is its place in the plan and part of every draw."""

    number: int
    type: str
    pct: float
    params: dict = field(default_factory=dict)

    @property
    def edits_content(self) -> bool:
        return self.type in CONTENT_STEPS or self.by_row

    @property
    def by_row(self) -> bool:
        return self.type in ROW_STEPS


def register_step(name: str, transform: Callable[..., DataFrame]) -> None:
    """Make ``transform(trace, step, seed) -> trace`` available to plans as ``name``.

    It runs among the selection steps. For a function of one packet see :func:`register_row_step`.
    """
    CUSTOM_STEPS[_own_name(name)] = transform


def register_row_step(name: str, function: Callable, batched: bool = False) -> None:
    """Make ``function(frame, **params)`` available to plans as ``name``.

    It runs among the content steps, on each packet with probability ``pct``, and gives the frame that
    takes its place, several frames in a list, or None to drop the packet. Later content steps see a
    single frame only; an empty list changes nothing, but ends the editing. The frames of a list share
    the packet's place and time, and a dropped packet leaves the others' times alone. With ``batched``
    the function gets an Arrow array of frames and gives an array of lists, null dropping.
    """
    ROW_STEPS[_own_name(name)] = (function, batched)


def _own_name(name: str) -> str:
    key = name.lower()
    if key in STEP_NAMES:
        raise ValueError(f"{name!r} is a built-in step")
    CUSTOM_STEPS.pop(key, None)
    ROW_STEPS.pop(key, None)
    return key


def parse_hex_pad(value: str | bytes | None) -> bytes:
    """Pad byte of a plan: one byte in hex; anything else counts as 00."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value) if len(value) == 1 else b"\x00"
    try:
        pad = bytes.fromhex(value or "")
    except ValueError:
        pad = b""
    return pad if len(pad) == 1 else b"\x00"


def parse_pad_argument(text: str) -> bytes:
    """Pad byte of a command line: ``0x0f``, decimal ``15``, or hex ``0F``."""
    text = text.strip().lower()
    if text.startswith("0x"):
        bases = (16,)
    else:
        bases = (10, 16)
    for base in bases:
        try:
            value = int(text, base)
        except ValueError:
            continue
        if 0 <= value <= 255:
            return bytes([value])
        break
    raise ValueError(f"pad must be a byte value 0..255, not {text!r}")


def check_percent(percent: float) -> float:
    if not 0.0 <= percent <= 100.0:
        raise ValueError(f"percent must be within 0..100, not {percent}")
    return float(percent)


def _read_params(kind: str, params: dict) -> dict:
    if kind == "reorder":
        m = int(params.get("m", DEFAULT_SEGMENT))
        if m < 2:
            raise ValueError(f"reorder needs m >= 2, not {m}")
        method = params.get("method")
        if method not in (None, *REORDER_METHODS):
            raise ValueError(f"reorder method must be one of {REORDER_METHODS}, not {method!r}")
        return {"m": m} | ({"method": method} if method else {})
    if kind == "seq_offset":
        checksums = params.get("checksums")
        if checksums not in (None, *CHECKSUM_WAYS):
            raise ValueError(f"checksums must be one of {CHECKSUM_WAYS}, not {checksums!r}")
        return {"offset": int(params.get("offset", DEFAULT_OFFSET))} | ({"checksums": checksums} if checksums else {})
    if kind == "length_forge":
        new_len = params.get("new_len")
        new_len = int(new_len) if new_len else None
        if new_len is not None and new_len < 0:
            raise ValueError(f"new_len must be >= 0, not {new_len}")
        return {"new_len": new_len, "pad": parse_hex_pad(params.get("pad_byte", b"\x00"))}
    return dict(params)


def read_plan(raw: list[dict]) -> list[Step]:
    """Validate a decoded JSON plan."""
    steps = []
    for number, entry in enumerate(raw):
        name = str(entry.get("type", "")).lower()
        kind = STEP_NAMES.get(name, name if name in CUSTOM_STEPS or name in ROW_STEPS else None)
        if kind is None:
            raise ValueError(f"step {number}: unknown type {entry.get('type')!r}")
        pct = float(entry.get("pct", 1.0 if kind == "rate_modify" else 0.0))
        if not 0.0 <= pct <= 1.0:
            raise ValueError(f"step {number}: pct must be within 0..1, not {pct}")
        steps.append(Step(number, kind, pct, _read_params(kind, entry.get("params") or {})))
    if not steps:
        raise ValueError("the plan has no steps")
    return steps


def load_plan(text: str) -> list[Step]:
    """Plan from JSON text."""
    return read_plan(json.loads(text))


# Quick flags of a command line, in the order in which their steps run, and what follows the colon.
QUICK_FLAGS = {"loss": None, "retransmit": None, "seq_offset": "offset", "length_forge": "new_len"}


def quick_step(kind: str, text: str | float) -> dict:
    """Plan entry of a quick flag: ``pct``, and ``:value`` for the steps that take one."""
    share, colon, value = str(text).partition(":")
    parameter = QUICK_FLAGS[kind]
    wanted = "pct" if parameter is None else f"pct:{parameter}"
    try:
        entry = {"type": kind, "pct": float(share)}
        if bool(colon) != bool(parameter):
            raise ValueError(text)
        return entry | ({"params": {parameter: int(value)}} if parameter else {})
    except ValueError:
        raise ValueError(f"{kind} takes {wanted}, not {text!r}") from None


def plan_from_flags(**flags: str | float | None) -> list[Step]:
    """Plan of the quick flags that are given, in their fixed order."""
    return read_plan([quick_step(kind, flags[kind]) for kind in QUICK_FLAGS if flags.get(kind) is not None])


def plan_text(steps: list[Step]) -> str:
    """Plan as JSON text, for the run ledger."""
    shown = [
        {
            "type": step.type,
            "pct": step.pct,
            "params": {k: v.hex() if isinstance(v, bytes) else v for k, v in step.params.items()},
        }
        for step in steps
    ]
    return json.dumps(shown)
