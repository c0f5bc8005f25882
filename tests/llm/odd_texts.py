"""Texts that operators must take as they are."""

LONG = "the value of x is 12 " * 6000
ODD_TEXTS = [
    None, "", " \n\t ", "one", LONG, LONG, "a" * 20_000, " " * 20_000,
    "naïve café — 中文 😀 ²½ é İ", "<|endoftext|> twice <|endoftext|>", "same text", "same text",
    "it's we'll I'd you're 'tis ''s", "x\ty\r\nz\n\n\n  end  ", "\x00\x1c nul", "1.2.3.4 and 4111 1111 1111 1111",
]
