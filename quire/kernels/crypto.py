"""The standard security handler, revisions 2 to 6: RC4, AES-CBC, passwords, object keys; and an encryptor for tests."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from quire.kernels.syntax import Name, Str, Stream

# fixed value: the padding string of the format
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray(len(data))
    for n, c in enumerate(data):
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[s[i] + s[j] & 255]
    return bytes(out)


def _field() -> tuple[list[int], list[int]]:
    """AES substitution box and its inverse, from inverses in GF(256)."""
    p = q = 1
    box = [0] * 256
    while True:
        p = p ^ (p << 1) & 255 ^ (0x1B if p & 128 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 128:
            q ^= 9
        x = q ^ (q << 1 | q >> 7) & 255 ^ (q << 2 | q >> 6) & 255 ^ (q << 3 | q >> 5) & 255 ^ (q << 4 | q >> 4) & 255
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inverse = [0] * 256
    for i, v in enumerate(box):
        inverse[v] = i
    return box, inverse


SBOX, INVERSE = _field()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a * (b & 1)
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out & 255


_T = [[(_times(s, 2) << 24 | s << 16 | s << 8 | _times(s, 3)) for s in SBOX]]
_D = [[(_times(i, 14) << 24 | _times(i, 9) << 16 | _times(i, 13) << 8 | _times(i, 11)) for i in INVERSE]]
for _t in (_T, _D):
    for _r in (8, 16, 24):
        _t.append([(v >> _r | v << 32 - _r) & 0xFFFFFFFF for v in _t[0]])
_MIX = [[(_times(i, 14) << 24 | _times(i, 9) << 16 | _times(i, 13) << 8 | _times(i, 11)) >> r & 0xFFFFFFFF | ((_times(i, 14) << 24 | _times(i, 9) << 16 | _times(i, 13) << 8 | _times(i, 11)) << 32 - r & 0xFFFFFFFF if r else 0) for i in range(256)] for r in (0, 8, 16, 24)]


class AES:
    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        w = list(struct.unpack(f">{n}I", key))
        rcon = 1
        for i in range(n, 4 * (self.rounds + 1)):
            t = w[-1]
            if i % n == 0:
                t = (t << 8 | t >> 24) & 0xFFFFFFFF
                t = SBOX[t >> 24] << 24 | SBOX[t >> 16 & 255] << 16 | SBOX[t >> 8 & 255] << 8 | SBOX[t & 255]
                t ^= rcon << 24
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = SBOX[t >> 24] << 24 | SBOX[t >> 16 & 255] << 16 | SBOX[t >> 8 & 255] << 8 | SBOX[t & 255]
            w.append(w[i - n] ^ t)
        self.enc = [w[i : i + 4] for i in range(0, len(w), 4)]
        self.dec = [self.enc[-1]] + [[_MIX[0][x >> 24] ^ _MIX[1][x >> 16 & 255] ^ _MIX[2][x >> 8 & 255] ^ _MIX[3][x & 255] for x in k] for k in self.enc[-2:0:-1]] + [self.enc[0]]

    def _block(self, data: bytes, keys, tables, box, step: int) -> bytes:
        s = [a ^ b for a, b in zip(struct.unpack(">4I", data), keys[0])]
        t0, t1, t2, t3 = tables
        for k in keys[1:-1]:
            s = [t0[s[i] >> 24] ^ t1[s[(i + step) % 4] >> 16 & 255] ^ t2[s[(i + 2) % 4] >> 8 & 255] ^ t3[s[(i - step) % 4] & 255] ^ k[i] for i in range(4)]
        k = keys[-1]
        return struct.pack(">4I", *((box[s[i] >> 24] << 24 | box[s[(i + step) % 4] >> 16 & 255] << 16 | box[s[(i + 2) % 4] >> 8 & 255] << 8 | box[s[(i - step) % 4] & 255]) ^ k[i] for i in range(4)))

    def encrypt_cbc(self, iv: bytes, data: bytes) -> bytes:
        out, last = [], iv
        for i in range(0, len(data), 16):
            last = self._block(bytes(a ^ b for a, b in zip(data[i : i + 16], last)), self.enc, _T, SBOX, 1)
            out.append(last)
        return b"".join(out)

    def decrypt_cbc(self, iv: bytes, data: bytes) -> bytes:
        out, last = [], iv
        for i in range(0, len(data) - 15, 16):
            block = data[i : i + 16]
            out.append(bytes(a ^ b for a, b in zip(self._block(block, self.dec, _D, INVERSE, -1), last)))
            last = block
        return b"".join(out)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """IV first, then padded blocks; odd padding is left as it is."""
    if len(data) < 32:
        return b""
    out = AES(key).decrypt_cbc(data[:16], data[16:])
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    pad = 16 - len(data) % 16
    return iv + AES(key).encrypt_cbc(iv, data + bytes([pad]) * pad)


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while True:
        e = AES(k[:16]).encrypt_cbc(k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


@dataclass
class Security:
    key: bytes
    which: str  # user or owner
    streams: str  # RC4, AESV2, AESV3 or Identity
    strings: str
    metadata: bool = True
    encrypt_num: int | None = None

    @property
    def method(self) -> str:
        return self.streams if self.streams != "Identity" else self.strings

    def _key(self, cipher: str, num: int, gen: int) -> bytes:
        if cipher == "AESV3":
            return self.key
        salt = num.to_bytes(3, "little") + (gen & 0xFFFF).to_bytes(2, "little") + (b"sAlT" if cipher == "AESV2" else b"")
        return hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]

    def apply(self, cipher: str, num: int, gen: int, data: bytes) -> bytes:
        if cipher == "Identity" or not data:
            return data
        key = self._key(cipher, num, gen)
        return rc4(key, data) if cipher == "RC4" else aes_decrypt(key, data)

    def strings_of(self, v, num: int, gen: int):
        if isinstance(v, Str):
            return Str(self.apply(self.strings, num, gen, v.data))
        if isinstance(v, list):
            return [self.strings_of(x, num, gen) for x in v]
        if isinstance(v, dict):
            signature = "ByteRange" in v and "Contents" in v
            return {k: x if signature and k == "Contents" else self.strings_of(x, num, gen) for k, x in v.items()}
        return v

    def decrypt_object(self, doc, num: int, gen: int, v):
        if num == self.encrypt_num:
            return v
        if not isinstance(v, Stream):
            return self.strings_of(v, num, gen)
        kind = v.dict.get("Type")
        if kind == "XRef" or kind == "Metadata" and not self.metadata:
            return v
        names, parms = doc.filters_of(v)
        cipher = self.streams
        if "Crypt" in names:
            named = (parms[names.index("Crypt")] if names.index("Crypt") < len(parms) else {}).get("Name", "Identity")
            cipher = "Identity" if named == "Identity" else cipher
        return Stream(self.strings_of(v.dict, num, gen), self.apply(cipher, num, gen, v.data))


def _file_key(password: bytes, d: dict, length: int, file_id: bytes) -> bytes:
    data = (password + PAD)[:32] + d["O"].data[:32] + struct.pack("<I", d["P"] & 0xFFFFFFFF) + file_id
    if d["R"] >= 4 and d.get("EncryptMetadata") is False:
        data += b"\xff\xff\xff\xff"
    key = hashlib.md5(data).digest()
    for _ in range(50 if d["R"] >= 3 else 0):
        key = hashlib.md5(key[:length]).digest()
    return key[:length]


def _user_check(key: bytes, d: dict, file_id: bytes) -> bytes:
    if d["R"] == 2:
        return rc4(key, PAD)
    x = rc4(key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        x = rc4(bytes(c ^ i for c in key), x)
    return x


def _owner_key(password: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    return key[:length]


def authenticate(doc, password: str) -> Security | None:
    """The document's security if the password is the user's or the owner's."""
    raw = doc.trailer.get("Encrypt")
    d = {k: doc.get(v) for k, v in doc.dict(raw).items()}
    num = getattr(raw, "num", None)
    if d.get("Filter") != "Standard" or not all(isinstance(d.get(k), Str) for k in "OU") or not isinstance(d.get("R"), int) or not isinstance(d.get("P"), (int, float)):
        return None
    d["P"] = int(d["P"])
    version, revision = d.get("V", 0), d["R"]

    def cipher(which: str) -> str:
        if version in (1, 2):
            return "RC4"
        name = d.get(which, "Identity")
        if name == "Identity":
            return "Identity"
        found = doc.get(doc.dict(doc.dict(d.get("CF")).get(str(name))).get("CFM"))
        return {"V2": "RC4", "AESV2": "AESV2", "AESV3": "AESV3"}.get(str(found), "Identity")

    streams, strings = cipher("StmF"), cipher("StrF")
    metadata = d.get("EncryptMetadata") is not False
    if revision >= 5:
        pw = password.encode()[:127]
        u, o = d["U"].data, d["O"].data
        digest = hash_r6 if revision >= 6 else lambda p, s, x=b"": hashlib.sha256(p + s + x).digest()
        for which, check, salt, wrapped, extra in (("user", u[:32], u[32:40], "UE", b""), ("owner", o[:32], o[32:40], "OE", u[:48])):
            if digest(pw, salt, extra) == check:
                k = digest(pw, (u if which == "user" else o)[40:48], extra)
                return Security(AES(k).decrypt_cbc(bytes(16), d[wrapped].data[:32]), which, streams, strings, metadata, num)
        return None
    pw = password.encode("latin-1", "replace")
    bits = d.get("Length", 40)
    length = 5 if version == 1 else 16 if version == 4 else max(5, min(16, int(bits) // 8))
    ids = doc.list(doc.trailer.get("ID"))
    file_id = ids[0].data if ids and isinstance(doc.get(ids[0]), Str) else b""

    def fits(candidate: bytes) -> bytes | None:
        key = _file_key(candidate, d, length, file_id)
        n = 32 if revision == 2 else 16
        return key if _user_check(key, d, file_id)[:n] == d["U"].data[:n] else None

    if (key := fits(pw)) is not None:
        return Security(key, "user", streams, strings, metadata, num)
    owner = _owner_key(pw, revision, length)
    user = d["O"].data[:32]
    for i in range(19, -1, -1) if revision >= 3 else (0,):
        user = rc4(bytes(c ^ i for c in owner), user)
    if (key := fits(user)) is not None:
        return Security(key, "owner", streams, strings, metadata, num)
    return None


def encrypt(objects: dict[int, object], trailer: dict, method: str, user: str, owner: str = "owner") -> tuple[dict[int, object], dict]:
    """Objects and trailer of an encrypted copy: method rc4, aes128 or aes256 (revision 6). Deterministic, for tests."""
    file_id = hashlib.md5(repr(sorted(objects)).encode()).digest()
    cf = {"rc4": None, "aes128": "AESV2", "aes256": "AESV3"}[method]
    d: dict = {"Filter": Name("Standard"), "P": -4}
    num = max(objects) + 1
    if method == "aes256":
        u, o = user.encode(), owner.encode()
        us, uk, os_, ok = (hashlib.sha256(bytes([i]) + file_id).digest()[:8] for i in range(4))
        key = hashlib.sha256(b"key" + file_id).digest()
        udata = hash_r6(u, us) + us + uk
        odata = hash_r6(o, os_, udata) + os_ + ok
        d |= {"V": 5, "R": 6, "Length": 256, "U": Str(udata), "O": Str(odata), "UE": Str(AES(hash_r6(u, uk)).encrypt_cbc(bytes(16), key)), "OE": Str(AES(hash_r6(o, ok, udata)).encrypt_cbc(bytes(16), key)), "Perms": Str(bytes(16))}
    else:
        revision = 3 if method == "rc4" else 4
        okey = _owner_key(owner.encode(), revision, 16)
        x = (user.encode() + PAD)[:32]
        for i in range(20):
            x = rc4(bytes(c ^ i for c in okey), x)
        d |= {"V": 2 if method == "rc4" else 4, "R": revision, "Length": 128, "O": Str(x)}
        key = _file_key(user.encode(), d, 16, file_id)
        d["U"] = Str(_user_check(key, d, file_id) + bytes(16))
    if cf:
        d |= {"CF": {"StdCF": {"CFM": Name(cf), "Length": 32 if cf == "AESV3" else 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    security = Security(key, "user", cf or "RC4", cf or "RC4")

    def seal(n: int, data: bytes) -> bytes:
        k = security._key(security.streams, n, 0)
        return rc4(k, data) if not cf else aes_encrypt(k, hashlib.md5(b"%d" % n + data).digest(), data)

    def strings(v, n: int):
        if isinstance(v, Str):
            return Str(seal(n, v.data))
        if isinstance(v, list):
            return [strings(x, n) for x in v]
        if isinstance(v, dict):
            return {k: strings(x, n) for k, x in v.items()}
        return v

    out = {n: Stream(strings(v.dict, n), seal(n, v.data)) if isinstance(v, Stream) else strings(v, n) for n, v in objects.items()}
    out[num] = d
    from quire.kernels.syntax import Ref

    return out, trailer | {"Encrypt": Ref(num), "ID": [Str(file_id), Str(file_id)]}
