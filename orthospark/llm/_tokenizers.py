"""Where the public tokenizers' files are; operators take the paths as parameters."""


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> str:
    """The 50k byte-level vocabulary."""
    return path("byte_bpe_50k.json")


def pieces() -> str:
    return path("piece_bpe_32k.model")
