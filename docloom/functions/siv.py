"""AES-256-SIV (RFC 5297) over numpy, for pseudonyms: equal values give equal tokens under one key and scope.

Spark has no SIV mode and no such library is assumed, so AES itself (FIPS 197) is here; its tables follow from the
field GF(2^8) by rule. Values of a batch that are equally long are sealed together, block by block.
"""

from __future__ import annotations

import base64

import numpy as np


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _sbox() -> np.ndarray:
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        spread = sum(((inverse << i | inverse >> (8 - i)) & 0xFF) << (8 * i) for i in range(5))
        box[x] = (spread ^ spread >> 8 ^ spread >> 16 ^ spread >> 24 ^ spread >> 32) & 0xFF ^ 0x63
    return box


SBOX = _sbox()
TWICE = np.array([_times(x, 2) for x in range(256)], np.uint8)
SHIFT = np.array([(4 * ((i // 4 + i % 4) % 4) + i % 4) for i in range(16)])


def schedule(key: bytes) -> np.ndarray:
    """The 15 round keys of a 32-byte key."""
    words = [list(key[i : i + 4]) for i in range(0, 32, 4)]
    constant = 1
    for i in range(8, 60):
        word = list(words[-1])
        if i % 8 == 0:
            word = [int(SBOX[b]) for b in word[1:] + word[:1]]
            word[0] ^= constant
            constant = _times(constant, 2)
        elif i % 8 == 4:
            word = [int(SBOX[b]) for b in word]
        words.append([a ^ b for a, b in zip(words[i - 8], word, strict=True)])
    return np.array(words, np.uint8).reshape(15, 16)


def encrypt(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Encrypts rows of 16 bytes."""
    state = blocks ^ keys[0]
    for n in range(1, 15):
        state = SBOX[state][:, SHIFT]
        if n < 14:
            c = state.reshape(-1, 4, 4)
            every = c[:, :, 0] ^ c[:, :, 1] ^ c[:, :, 2] ^ c[:, :, 3]
            state = (c ^ every[:, :, None] ^ TWICE[c ^ np.roll(c, -1, axis=2)]).reshape(-1, 16)
        state = state ^ keys[n]
    return state


def _double(block: bytes) -> bytes:
    n = int.from_bytes(block, "big") << 1
    return ((n & (1 << 128) - 1) ^ (0x87 if n >> 128 else 0)).to_bytes(16, "big")


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


class Siv:
    """Deterministic sealing under a 64-byte key."""

    def __init__(self, key: bytes) -> None:
        if len(key) != 64:
            raise ValueError("a key of 64 bytes is needed")
        self.mac_keys, self.ctr_keys = schedule(key[:32]), schedule(key[32:])
        self.k1 = _double(self._block(self.mac_keys, bytes(16)))
        self.k2 = _double(self.k1)

    @staticmethod
    def _block(keys: np.ndarray, data: bytes) -> bytes:
        return encrypt(keys, np.frombuffer(data, np.uint8)[None]).tobytes()

    def cmac(self, data: np.ndarray) -> np.ndarray:
        """Of each row of bytes, 16 bytes."""
        n, size = data.shape
        whole = max(0, -(-size // 16) - 1)
        last = np.zeros((n, 16), np.uint8)
        last[:, : size - 16 * whole] = data[:, 16 * whole :]
        full = size and size % 16 == 0
        if not full:
            last[:, size - 16 * whole] = 0x80
        last ^= np.frombuffer(self.k1 if full else self.k2, np.uint8)
        state = np.zeros((n, 16), np.uint8)
        for i in range(whole):
            state = encrypt(self.mac_keys, state ^ data[:, 16 * i : 16 * i + 16])
        return encrypt(self.mac_keys, state ^ last)

    def seal(self, header: bytes, data: np.ndarray) -> np.ndarray:
        """Of each row of bytes the synthetic IV, then the ciphertext."""
        n, size = data.shape
        one = lambda x: self.cmac(np.frombuffer(x, np.uint8)[None]).tobytes()
        d = _xor(_double(one(bytes(16))), one(header))
        if size >= 16:
            mixed = data.copy()
            mixed[:, -16:] ^= np.frombuffer(d, np.uint8)
        else:
            mixed = np.zeros((n, 16), np.uint8)
            mixed[:, :size], mixed[:, size] = data, 0x80
            mixed ^= np.frombuffer(_double(d), np.uint8)
        iv = self.cmac(mixed)
        start = iv.copy()
        start[:, [8, 12]] &= 0x7F
        blocks = -(-size // 16)
        counters = np.repeat(start[:, None], blocks, axis=1)
        low = start[:, 12:].copy().view(">u4").astype(np.int64) + np.arange(blocks)  # its top bit is free, so nothing is carried
        counters[:, :, 12:] = low.astype(">u4").reshape(n, blocks, 1).view(np.uint8)
        stream = encrypt(self.ctr_keys, counters.reshape(-1, 16)).reshape(n, -1)
        return np.concatenate([iv, data ^ stream[:, :size]], axis=1)

    def tokens(self, scope: str, texts: list[str]) -> list[str]:
        """URL-safe base64 without padding of each sealed text."""
        coded = [t.encode() for t in texts]
        by_size: dict[int, list[int]] = {}
        for i, c in enumerate(coded):
            by_size.setdefault(len(c), []).append(i)
        out = [""] * len(texts)
        for size, some in by_size.items():
            data = np.frombuffer(b"".join(coded[i] for i in some), np.uint8).reshape(len(some), size)
            for i, sealed in zip(some, self.seal(scope.encode(), data), strict=True):
                out[i] = base64.urlsafe_b64encode(sealed.tobytes()).decode().rstrip("=")
        return out

    def token(self, scope: str, text: str) -> str:
        return self.tokens(scope, [text])[0]
