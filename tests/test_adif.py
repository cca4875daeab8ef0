from skylog.sources.adif import decode_text, parse_text


def parsed(text):
    rows = list(parse_text(text))
    records = [f for n, f, _ in rows if n > 0 and f is not None]
    header = next(f for n, f, _ in rows if n == 0)
    codes = [(n, c, name) for n, _, notes in rows for c, name, _ in notes]
    return header, records, codes


def test_header_and_case():
    h, r, w = parsed("free text\n<adif_ver:5>3.1.4 <eoh>\n<call:5>YU1AB <Band:3:S>20m<eor>")
    assert h == {"ADIF_VER": "3.1.4"} and r == [{"CALL": "YU1AB", "BAND": "20m"}] and w == []


def test_no_header_and_missing_eor():
    _, r, w = parsed("<CALL:4>YU1A<EOR><CALL:4>YU1B")
    assert [x["CALL"] for x in r] == ["YU1A", "YU1B"] and w == [(2, "missing_eor", None)]


def test_length_in_characters_and_in_bytes():
    _, r, w = parsed("<NAME:5>Đorđe<CALL:4>YU1A<EOR>")
    assert r[0]["NAME"] == "Đorđe" and w == []
    _, r, w = parsed("<NAME:7>Đorđe<CALL:4>YU1A<EOR>")
    assert r == [{"NAME": "Đorđe", "CALL": "YU1A"}] and w == [(1, "byte_length", "NAME")]


def test_wrong_lengths():
    _, r, w = parsed("<CALL:3>YU1AB <BAND:3>20m<EOR>")
    assert r[0]["CALL"] == "YU1" and w == [(1, "length_mismatch", "CALL")]
    _, r, w = parsed("<CALL:50>YU1AB")
    assert r[0]["CALL"] == "YU1AB" and w[0] == (1, "past_end", "CALL")
    _, r, _ = parsed("<CALL:99999999999999999999>YU1AB")
    assert r[0]["CALL"] == "YU1AB"


def test_comments_markers_and_bad_tags():
    _, r, w = parsed("<MY_STATE:2>CO // Colorado\n<CALL:4>YU1A<EOR><APP_X_EOF>")
    assert r == [{"MY_STATE": "CO", "CALL": "YU1A"}] and w == []
    _, r, w = parsed("<CALL:x>A <CALL:4>YU1A <NOLEN> <EOR>")
    assert r == [{"CALL": "YU1A"}] and w == [(1, "bad_tag", None), (1, "no_length", "NOLEN")]


def test_user_defined_names():
    _, r, _ = parsed("<Seq (S):3>001<CALL:4>YU1A<EOR>")
    assert r == [{"SEQ (S)": "001", "CALL": "YU1A"}]
    _, r, _ = parsed("<CALL:4>YU1A <COMMENT:13>see <at 10:15> <EOR>")
    assert len(r) == 1 and r[0]["CALL"] == "YU1A"


def test_duplicates_last_wins():
    _, r, w = parsed("<CALL:4>YU1A<CALL:4>YU1B<EOR>")
    assert r == [{"CALL": "YU1B"}] and w == [(1, "duplicate_field", "CALL")]


def test_eoh_inside_values_and_joined_files():
    h, r, _ = parsed("<PROGRAMVERSION:7>x<EOH>y<EOH><CALL:4>YU1A<EOR>")
    assert h == {"PROGRAMVERSION": "x<EOH>y"} and r == [{"CALL": "YU1A"}]
    h, r, w = parsed("<CALL:4>YU1A<EOR>text<PROGRAMID:2>AB<EOH><CALL:4>YU1B<EOR>")
    assert h == {"PROGRAMID": "AB"} and [x["CALL"] for x in r] == ["YU1A", "YU1B"]
    assert w == [(2, "second_header", None)]
    h, r, w = parsed("<CALL:4>YU1A<ADIF_VER:1>3<EOH><CALL:4>YU1B<EOR>")
    assert h == {"ADIF_VER": "3"} and len(r) == 2 and w == [(1, "missing_eor", None)]
    _, r, _ = parsed("<CALL:4>YU1A<COMMENT:5><EOH><EOR>")
    assert r == [{"CALL": "YU1A", "COMMENT": "<EOH>"}]


def test_decoding():
    assert decode_text(b"\xef\xbb\xbfab") == ("ab", False)
    assert decode_text("žabac".encode("utf-16")) == ("žabac", False)
    assert decode_text(b"M\xfcller") == ("Müller", True)


def test_pathological_text_is_linear():
    text = "<a:9" * 40_000 + "<CALL:4>YU1A<EOR>" + "<x y:5>" * 20_000
    assert parsed(text)[1][0]["CALL"] == "YU1A"


def test_empty_values_kept():
    assert parsed("<CALL:4>YU1A<NAME:0><EOR>")[1] == [{"CALL": "YU1A", "NAME": ""}]
