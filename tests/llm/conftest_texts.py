ODD = [
    "", "  ", "a  <|endoftext|>  b", "it's don't ''s 'tis  '", "a\n\n b\t\tc \n d", "x\x0by", "naïve ÀÉ ß ΣΑΣ İx",
    "12345 6.7", "éa  b", "漢字かな ｶﾞ 한국어", "<|startoftext|>", "\U0010ffff a", "tail  ", "tail\n\n", " ",
    "a😀b 👍🏽", "ﬁ ǅ", "a\x1cb", "  lead", "\r\n x", "'S 'RE", "don’t – — …", "w" * 5000, "ȩ́ Å",
]
