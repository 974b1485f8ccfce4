"""Programs built from their parts."""


def program(working: str, code: str, files: str = "", linkage: str = "", control: str = "") -> str:
    def pad(text: str) -> str:
        return "\n".join("       " + ln if ln.strip() else ln for ln in text.strip("\n").splitlines())

    return "\n".join([
        "       IDENTIFICATION DIVISION.", "       PROGRAM-ID. CASE1.", *(["       ENVIRONMENT DIVISION.", "       INPUT-OUTPUT SECTION.", "       FILE-CONTROL.", pad(control)] if control else []), "       DATA DIVISION.",
        *(["       FILE SECTION.", pad(files)] if files else []), "       WORKING-STORAGE SECTION.", pad(working), *(["       LINKAGE SECTION.", pad(linkage)] if linkage else []), "       PROCEDURE DIVISION.", pad(code),
    ])
