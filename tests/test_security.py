import pytest

from docframe.sources import ciphers, pdf, writer

H = bytes.fromhex


def test_rc4_vectors():
    assert ciphers.rc4(b"Key", b"Plaintext") == H("BBF316E8D940AF0AD3")
    assert ciphers.rc4(b"Wiki", b"pedia") == H("1021BF0420")


def test_aes_vectors():
    plain = H("00112233445566778899aabbccddeeff")
    for key, cipher in ((bytes(range(16)), "69c4e0d86a7b0430d8cdb78070b4c55a"), (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089")):
        assert ciphers.aes_cbc_encrypt(key, bytes(16), plain) == H(cipher)
        assert ciphers.aes_cbc_decrypt(key, bytes(16), H(cipher)) == plain
    long = bytes(range(256)) * 3
    assert ciphers.aes_cbc_decrypt(bytes(16), plain, ciphers.aes_cbc_encrypt(bytes(16), plain, long)) == long


@pytest.mark.parametrize("method", ["V2", "AESV2", "AESV3"])
def test_protected_files(method):
    made = writer.text_file("first line\nsecond ünïcode → line", encrypt=method, user_password=b"secret")
    assert pdf.Document(made).locked
    for password, owner in ((b"secret", False), (b"owner", True)):
        doc = pdf.Document(made, password)
        assert (doc.locked, doc.security.is_owner) == (False, owner)
        [(_, page)] = doc.pages()
        assert doc.contents(page).startswith(b"BT /F1 10 Tf")


def test_protected_rows(spark):
    made = writer.text_file("x", encrypt="V2", user_password=b"pw")
    files = spark.createDataFrame([("a", bytearray(made))], "path string, content binary")
    assert pdf.read(files, "pages").first().status == "password required"
    info = pdf.read(files, "documents", "pw").first()
    assert (info.is_encrypted, info.is_locked, info.permissions) == (True, False, -4)
