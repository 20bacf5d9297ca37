"""OCR-like noise: rare changes of single characters.

Written natively this is a draw per character (or per short run of characters)
inside an array function, which Spark interprets.  Jumping from change to change
is much cheaper, so this is an Arrow function: the distance to the next change is
geometric, and Python touches only the characters that change.  Draw ``k`` of a
text is the MD5 digest of its key and ``k``: any engine can repeat it.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatmill.functions.draws import digest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Look-alikes; every other character has none.
LOOKALIKES = {
    "0": "O", "O": "0", "1": "l", "l": "1", "I": "1", "5": "S", "S": "5", "8": "B", "B": "8",
    "G": "6", "m": "rn",
}

#: Thirteen hex digits of a digest are a number below this.
_WHOLE = float(1 << 52)


def hits(key: str, size: int, rate: float) -> Iterator[tuple[int, float]]:
    """(place, choice) of all hits: each of ``size`` places with probability ``rate``; choices lie in [0, 1)."""
    miss = math.log(1 - rate) if rate < 1 else -math.inf
    place, draw = -1, 0
    while True:
        drawn = hashlib.md5(f"{key}:{draw}".encode()).hexdigest()
        place += int(math.log(1 - int(drawn[:13], 16) / _WHOLE) / miss) + 1
        if place >= size:
            return
        yield place, int(drawn[13:26], 16) / _WHOLE
        draw += 1


def noisy_text(text: str, key: str, rate: float) -> str:
    """Drop, swap for a look-alike or double each letter or digit that is hit."""
    parts, end = [], 0
    for place, choice in hits(key, len(text), rate):
        char = text[place]
        if not char.isalnum():
            continue
        parts.append(text[end:place])
        end = place + 1
        if choice >= 2 / 3:
            parts.append(char + char)
        elif choice >= 1 / 3:
            parts.append(LOOKALIKES.get(char, char))
    return "".join(parts) + text[end:]


def add_noise(text: Column, rate: float, *key: Column) -> Column:
    """Noise on ``text``, repeatable for the same key columns; rate 0 leaves it alone."""
    if rate <= 0:
        return text

    @F.arrow_udf(StringType())
    def noisy(texts: pa.Array, keys: pa.Array) -> pa.Array:
        both = zip(texts.to_pylist(), keys.to_pylist())
        return pa.array([noisy_text(t, k, rate) if t else t for t, k in both], pa.string())

    # See chatmill.functions.answers on the declaration.
    return noisy.asNondeterministic()(text, digest(*key))
