"""Cursors that only fit the question they came from."""

from __future__ import annotations

import base64
import hashlib
import json


class StaleCursor(ValueError):
    """The cursor belongs to another question, generation or budget, or was changed."""


def encode_cursor(binding: dict, position: list) -> str:
    """Text of a position bound to what was asked: project, generation, query, order, budget or whatever ``binding`` holds."""
    body = json.dumps(position, separators=(",", ":"), ensure_ascii=False)
    digest = hashlib.sha256((json.dumps(binding, sort_keys=True, ensure_ascii=False) + "\0" + body).encode()).hexdigest()[:32]
    return base64.urlsafe_b64encode(f"{digest}{body}".encode()).decode().rstrip("=")


def decode_cursor(binding: dict, cursor: str) -> list:
    """The position, if the cursor was made for this binding."""
    try:
        text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
        position = json.loads(text[32:])
    except ValueError as e:
        raise StaleCursor("not a cursor") from e
    if not isinstance(position, list) or encode_cursor(binding, position) != cursor.rstrip("="):
        raise StaleCursor("cursor of another question")
    return position
