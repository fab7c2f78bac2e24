"""The Vietnamese language pack: word lists, lookup tables and patterns, all over folded text (capitals without marks).

Every table in this module is a FIXED VALUE: results depend on it being exactly this. Other languages and dictionaries
take the place of any of them through the `pack` parameters of the operators.
"""

from __future__ import annotations

# --- reports -----------------------------------------------------------------------------------------------------------

#: Cells that mean "no number"; the empty cell counts as one too when numbers are parsed.
NULL_CELLS = ["-", "--", "---", "–", "—", ".", ",", "x", "X", "n/a", "N/A", "NA", "*"]

#: Unit patterns of a table, in order, with their factors.
TABLE_UNITS = [
    (r"(?<![A-Z])NGHIN\s*TY\b", 1e12),
    (r"(?<![A-Z])(?<!CONG )TY\s*(VND|DONG)\b", 1e9),
    (r"(?<![A-Z])TRIEU\s*(VND|DONG)\b", 1e6),
    (r"(?<![A-Z])(NGHIN|NGAN)\s*(VND|DONG)\b", 1e3),
    (r"(?<![A-Z])(VND|DONG)\b", 1.0),
]

#: What a column header says about its period.
PERIODS = {
    "date": r"(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(20\d{2})",
    "named_year": r"(?<![A-Z])NAM\s*(20\d{2})(?![0-9])",
    "closing": r"\b(SO\s*)?(CUOI\s*(NAM|KY|QUY))\b",
    "opening": r"\b(SO\s*)?(DAU\s*(NAM|KY|QUY))\b",
    "this_year": r"\b(NAM|KY)\s*NAY\b",
    "last_year": r"\b(NAM|KY)\s*TRUOC\b",
    "bare_year": r"(?<![0-9])(20\d{2})(?![0-9])",
}

#: A form code, and the section that family and number stand for.
FORM_CODE = r"(?i)\bB\s*0?(\d{1,2})\s*[-–—/]\s*(DN|TCTD|CTCK|DNBH)"
FORM_SECTIONS = {
    "DN1": "CDKT", "DN2": "KQKD", "DN3": "LCTT", "DN4": "VCSH", "DN9": "TM",
    "DNBH1": "CDKT", "DNBH2": "KQKD", "DNBH3": "LCTT", "DNBH9": "TM",
    "CTCK1": "CDKT", "CTCK2": "KQKD", "CTCK3": "LCTT", "CTCK4": "VCSH", "CTCK5": "TM", "CTCK9": "TM",
    "TCTD2": "CDKT", "TCTD3": "KQKD", "TCTD4": "LCTT", "TCTD5": "TM", "TCTD6": "TM",
}

#: Headings in order, and the section that a line with one starts.
HEADINGS = [
    ("BANG CAN DOI KE TOAN", "CDKT"),
    ("BAO CAO TINH HINH TAI CHINH", "CDKT"),
    ("KET QUA HOAT DONG KINH DOANH", "KQKD"),
    ("KET QUA KINH DOANH", "KQKD"),
    ("LUU CHUYEN TIEN TE", "LCTT"),
    ("THAY DOI VON CHU SO HUU", "VCSH"),
    ("BIEN DONG VON CHU SO HUU", "VCSH"),
    ("THUYET MINH", "TM"),
]

#: Words of a section, and of a unit, in a table's passage.
SECTION_WORDS = {
    "CDKT": "BANG CAN DOI KE TOAN TAI SAN NGUON VON",
    "KQKD": "BAO CAO KET QUA HOAT DONG KINH DOANH DOANH THU CHI PHI LOI NHUAN",
    "LCTT": "BAO CAO LUU CHUYEN TIEN TE DONG TIEN",
    "VCSH": "THAY DOI VON CHU SO HUU",
    "TM": "THUYET MINH BAO CAO TAI CHINH",
}
UNIT_WORDS = {1.0: "VND", 1e3: "NGHIN VND", 1e6: "TRIEU VND", 1e9: "TY VND", 1e12: "NGHIN TY VND"}

# --- facts -------------------------------------------------------------------------------------------------------------

#: Companies by accounting scheme; all others are TT200.
ADAPTERS = {
    "TCTD": ["VCB", "MBB", "VPB", "CTG", "BID", "ACB", "HDB", "SHB", "SSB", "VIB", "MSB", "OCB", "NAB", "NVB", "STB", "EIB", "ABB", "BAB", "VAB", "KLB", "SGB", "EVF"],
    "TT334": ["SSI", "MBS", "FTS"],
    "TT232": ["BVH"],
}

#: Numbering before a label, and a note reference after it.
LABEL_NUMBERING = r"^\s*[\(\[]?\s*(?:[0-9]{1,2}|[IVXLC]{1,5}|[A-Ea-e])\s*[\)\].:-]\s*"
LABEL_NOTE = r"\s*\((?:THUYET MINH|TM)[^)]*\)\s*$"
#: Fixed value: a line code cell.
LINE_CODE = r"^\d{2,3}[a-zA-Z]?$"

#: Statutory line codes by section, and their concepts.
CODE_CONCEPTS = {
    "CDKT": {
        "100": "TAI_SAN_NGAN_HAN", "110": "TIEN_VA_TUONG_DUONG_TIEN", "111": "TIEN", "112": "TUONG_DUONG_TIEN",
        "120": "DTTC_NGAN_HAN", "130": "PHAI_THU_NGAN_HAN", "131": "PHAI_THU_KHACH_HANG_NGAN_HAN",
        "132": "TRA_TRUOC_NGUOI_BAN_NGAN_HAN", "140": "HANG_TON_KHO", "150": "TAI_SAN_NGAN_HAN_KHAC",
        "200": "TAI_SAN_DAI_HAN", "210": "PHAI_THU_DAI_HAN", "220": "TAI_SAN_CO_DINH", "221": "TSCD_HUU_HINH",
        "227": "TSCD_VO_HINH", "230": "BAT_DONG_SAN_DAU_TU", "240": "TAI_SAN_DO_DANG_DAI_HAN",
        "242": "XAY_DUNG_CO_BAN_DO_DANG", "250": "DTTC_DAI_HAN", "252": "DAU_TU_VAO_CONG_TY_LIEN_KET",
        "260": "TAI_SAN_DAI_HAN_KHAC", "261": "CHI_PHI_TRA_TRUOC_DAI_HAN", "270": "TONG_TAI_SAN",
        "300": "NO_PHAI_TRA", "310": "NO_NGAN_HAN", "311": "PHAI_TRA_NGUOI_BAN_NGAN_HAN",
        "312": "NGUOI_MUA_TRA_TIEN_TRUOC", "313": "THUE_PHAI_NOP", "320": "VAY_NGAN_HAN",
        "322": "QUY_KHEN_THUONG_PHUC_LOI", "330": "NO_DAI_HAN", "338": "VAY_DAI_HAN",
        "400": "VON_CHU_SO_HUU", "410": "VON_CHU_SO_HUU", "411": "VON_GOP_CUA_CHU_SO_HUU",
        "421": "LNST_CHUA_PHAN_PHOI", "440": "TONG_NGUON_VON",
    },
    "KQKD": {
        "01": "DOANH_THU_BAN_HANG", "02": "CAC_KHOAN_GIAM_TRU", "10": "DOANH_THU_THUAN", "11": "GIA_VON_HANG_BAN",
        "20": "LOI_NHUAN_GOP", "21": "DOANH_THU_TAI_CHINH", "22": "CHI_PHI_TAI_CHINH", "23": "CHI_PHI_LAI_VAY",
        "24": "LAI_LO_CONG_TY_LIEN_KET", "25": "CHI_PHI_BAN_HANG", "26": "CHI_PHI_QUAN_LY_DOANH_NGHIEP",
        "30": "LOI_NHUAN_THUAN_HDKD", "31": "THU_NHAP_KHAC", "32": "CHI_PHI_KHAC", "40": "LOI_NHUAN_KHAC",
        "50": "LOI_NHUAN_TRUOC_THUE", "51": "CHI_PHI_THUE_TNDN_HIEN_HANH", "52": "CHI_PHI_THUE_TNDN_HOAN_LAI",
        "60": "LOI_NHUAN_SAU_THUE", "61": "LNST_CO_DONG_CONG_TY_ME", "62": "LNST_CO_DONG_KHONG_KIEM_SOAT",
        "70": "LAI_CO_BAN_TREN_CO_PHIEU",
    },
    "LCTT": {
        "20": "LC_TIEN_THUAN_HDKD", "30": "LC_TIEN_THUAN_HDDT", "40": "LC_TIEN_THUAN_HDTC",
        "50": "LC_TIEN_THUAN_TRONG_KY", "60": "TIEN_DAU_KY", "70": "TIEN_CUOI_KY",
    },
}

#: Labels from their start, in order, and their concepts: of banks, and of all others.
BANK_LABELS = [
    (r"^TONG (CONG )?TAI SAN", "TONG_TAI_SAN"),
    (r"^TONG (CONG )?NGUON VON", "TONG_NGUON_VON"),
    (r"^TONG NO PHAI TRA", "NO_PHAI_TRA"),
    (r"^(TONG )?VON CHU SO HUU", "VON_CHU_SO_HUU"),
    (r"^CHO VAY KHACH HANG$", "CHO_VAY_KHACH_HANG"),
    (r"^TIEN GUI CUA KHACH HANG", "TIEN_GUI_KHACH_HANG"),
    (r"^TIEN GUI (VA CHO VAY )?(TAI )?CAC TO CHUC TIN DUNG", "TIEN_GUI_TAI_TCTD_KHAC"),
    (r"^TIEN MAT", "TIEN_MAT"),
    (r"^TIEN GUI TAI NGAN HANG NHA NUOC", "TIEN_GUI_TAI_NHNN"),
    (r"^CHUNG KHOAN (KINH DOANH|DAU TU)", "CHUNG_KHOAN"),
    (r"^THU NHAP LAI (VA CAC KHOAN )?THUAN|^THU NHAP LAI THUAN", "THU_NHAP_LAI_THUAN"),
    (r"^LAI( |/)?(LO)? THUAN TU HOAT DONG DICH VU", "LAI_THUAN_DICH_VU"),
    (r"^(TONG )?CHI PHI HOAT DONG", "CHI_PHI_HOAT_DONG"),
    (r"^CHI PHI DU PHONG RUI RO TIN DUNG", "CHI_PHI_DU_PHONG_TIN_DUNG"),
    (r"^(TONG )?LOI NHUAN TRUOC THUE", "LOI_NHUAN_TRUOC_THUE"),
    (r"^LOI NHUAN SAU THUE", "LOI_NHUAN_SAU_THUE"),
    (r"^VON DIEU LE", "VON_DIEU_LE"),
]
COMPANY_LABELS = [
    (r"^TONG CONG TAI SAN", "TONG_TAI_SAN"),
    (r"^TONG CONG NGUON VON", "TONG_NGUON_VON"),
    (r"^TAI SAN NGAN HAN$", "TAI_SAN_NGAN_HAN"),
    (r"^TAI SAN DAI HAN$", "TAI_SAN_DAI_HAN"),
    (r"^NO PHAI TRA$", "NO_PHAI_TRA"),
    (r"^NO NGAN HAN$", "NO_NGAN_HAN"),
    (r"^VON CHU SO HUU$", "VON_CHU_SO_HUU"),
    (r"^HANG TON KHO$", "HANG_TON_KHO"),
    (r"^DOANH THU THUAN", "DOANH_THU_THUAN"),
    (r"^GIA VON HANG BAN", "GIA_VON_HANG_BAN"),
    (r"^LOI NHUAN GOP", "LOI_NHUAN_GOP"),
    (r"^CHI PHI LAI VAY", "CHI_PHI_LAI_VAY"),
    (r"^CHI PHI BAN HANG", "CHI_PHI_BAN_HANG"),
    (r"^CHI PHI QUAN LY DOANH NGHIEP", "CHI_PHI_QUAN_LY_DOANH_NGHIEP"),
    (r"^(TONG )?LOI NHUAN (KE TOAN )?TRUOC THUE", "LOI_NHUAN_TRUOC_THUE"),
    (r"^LOI NHUAN SAU THUE( THU NHAP DOANH NGHIEP)?$", "LOI_NHUAN_SAU_THUE"),
    (r"^LUU CHUYEN TIEN THUAN TU HOAT DONG KINH DOANH", "LC_TIEN_THUAN_HDKD"),
    (r"^LUU CHUYEN TIEN THUAN TU HOAT DONG DAU TU", "LC_TIEN_THUAN_HDDT"),
    (r"^LUU CHUYEN TIEN THUAN TU HOAT DONG TAI CHINH", "LC_TIEN_THUAN_HDTC"),
]

#: Accounting identities (name, target, parts, how the parts make the target).
IDENTITIES = [
    ("270 == 440", "TONG_TAI_SAN", ["TONG_NGUON_VON"], "same"),
    ("100+200 == 270", "TONG_TAI_SAN", ["TAI_SAN_NGAN_HAN", "TAI_SAN_DAI_HAN"], "sum"),
    ("300+400 == 440", "TONG_NGUON_VON", ["NO_PHAI_TRA", "VON_CHU_SO_HUU"], "sum"),
    ("10-11 == 20", "LOI_NHUAN_GOP", ["DOANH_THU_THUAN", "GIA_VON_HANG_BAN"], "less"),
]

# --- questions ---------------------------------------------------------------------------------------------------------

_YEAR = r"(20[0-2]\d)"

#: Units that an answer is asked in, in order: pattern, kind, factor.
ANSWER_UNITS = [
    (r"DIEM\s*(PHAN\s*TRAM|%)", "pp", 1.0),
    (r"NGHIN\s*TY(\s*(DONG|VND))?", "vnd", 1e12),
    (r"TRAM\s*TY(\s*(DONG|VND))?", "vnd", 1e11),
    (r"(?<!CONG )TY\s*(DONG|VND)", "vnd", 1e9),
    (r"TRIEU\s*(DONG|VND)", "vnd", 1e6),
    (r"(NGHIN|NGAN)\s*(DONG|VND)", "vnd", 1e3),
    (r"\bUSD\b|\bDO\s*LA\b", "usd", 1.0),
    (r"CO\s*PHIEU", "shares", 1.0),
    (r"PHAN\s*TRAM|%", "percent", 1.0),
    (r"\bLAN\b", "times", 1.0),
    (r"\b(DONG|VND)\b", "vnd", 1.0),
]
ASK_PHRASE = r"BAO NHIEU|\bMAY\b|TINH THEO DON VI|TINH BANG|DON VI (TINH )?LA|KET QUA"
YEAR_ANSWER = r"NAM NAO|VAO NAM NAO|LA NAM MAY"
COUNT_ANSWER = r"CO BAO NHIEU (CONG TY|DOANH NGHIEP|DON VI|NGAN HANG|MA)"

#: Ranges of years (two groups), dates (the third group) and years alone.
YEAR_RANGES = [
    rf"GIAI DOAN {_YEAR}\s*[-–—]\s*{_YEAR}",
    rf"GIAI DOAN (?:TU )?(?:NAM )?{_YEAR} (?:DEN|TOI|-|–) (?:NAM )?{_YEAR}",
    rf"TU (?:NAM )?{_YEAR} (?:DEN|TOI) (?:NAM )?{_YEAR}",
    rf"(?:CAC )?NAM (?:TAI CHINH )?TU {_YEAR} DEN {_YEAR}",
    rf"{_YEAR}\s*[-–—]\s*{_YEAR}(?!\d)",
]
YEAR_DATES = [rf"(\d{{1,2}})\s*[/.\-]\s*(\d{{1,2}})\s*[/.\-]\s*{_YEAR}", rf"(\d{{1,2}}) THANG (\d{{1,2}}) NAM {_YEAR}"]
YEAR_ALONE = rf"(?<![0-9/.]){_YEAR}(?![0-9])"
YEAR_BOUNDS, RANGE_YEARS = (2010, 2026), 15

#: Points in time, statement scopes, operations.
TIME_POINTS = {
    "end": r"CUOI NAM|CUOI KY|CUOI QUY|DEN NGAY|TAI NGAY|VAO NGAY|TAI THOI DIEM|TINH DEN|THOI DIEM CUOI|SO CUOI",
    "begin": r"DAU NAM|DAU KY|SO DAU|01/01|1/1/",
    "period": r"TRONG NAM|TRONG KY|CA NAM|PHAT SINH TRONG|TRONG GIAI DOAN",
}
SCOPES = {
    "separate": r"CONG TY ME|RIENG LE|BAO CAO RIENG|CO SO RIENG|PHAM VI CONG TY ME|CO SO CONG TY ME|BAN THAN NGAN HANG",
    "consolidated": r"HOP NHAT|TOAN TAP DOAN|CA TAP DOAN",
}
OPERATIONS = {
    "GROWTH": r"TANG TRUONG|TOC DO TANG|TANG BAO NHIEU|GIAM BAO NHIEU|SO VOI NAM|SO VOI CUNG|BIEN DONG|THAY DOI BAO NHIEU|MUC TANG|MUC GIAM|TANG\s*/\s*GIAM",
    "DIFF": r"CHENH LECH|HIEU SO|TRU DI|CHENH BAO NHIEU|KHAC BIET|BIEN DONG|GIUA (CUOI )?NAM",
    "RATIO": r"TY LE|TY TRONG|TY SUAT|HE SO|BIEN LOI NHUAN|BIEN [A-Z]+ NHUAN|\bROE\b|\bROA\b|\bROS\b|\bCFO\b|\bD/E\b|GAP BAO NHIEU LAN|CHIEM BAO NHIEU|VONG QUAY|TREN DOANH THU|TREN TONG TAI SAN|KHA NANG THANH TOAN|CHIA CHO",
    "AGGREGATE": r"\bTONG\b|CONG LAI|TONG CONG|TONG SO",
    "AVERAGE": r"TRUNG BINH|BINH QUAN",
    "MEDIAN": r"TRUNG VI",
    "SUPERLATIVE": r"LON NHAT|CAO NHAT|NHO NHAT|THAP NHAT|NHIEU NHAT|IT NHAT LA|DAT GIA TRI LON|NAM NAO|DUNG DAU",
    "COUNT": COUNT_ANSWER,
    "CONDITIONAL": r"TRONG NHOM CO|XET CAC|CHI XET|NEU |GIA SU|GIA DINH|THEO KICH BAN|SAU KHI LOC|CO (LOI NHUAN|DOANH THU|DONG TIEN|LUU CHUYEN|CFO|BIEN|TY LE|TY SUAT|GIA TRI)[A-Z ]*DUONG|CAO HON TRUNG VI|THAP HON TRUNG VI",
}

#: Fixed value: what a retrieval query leaves out, besides tickers and names.
QUERY_NOISE = (
    r"LA BAO NHIEU|BAO NHIEU|CUA CONG TY ME|CONG TY ME|DEN NGAY|VAO CUOI|CTCP|CONG TY CO PHAN|TONG CONG TY|NGAN HANG TMCP|TAP DOAN|"
    r"\d{1,2}\s*/\s*\d{1,2}\s*/\s*20[0-2]\d|20[0-2]\d|DIEM PHAN TRAM|PHAN TRAM|TRIEU DONG|NGHIN TY DONG|TRAM TY DONG|TY DONG|\bLAN\b|[?%(),;]"
)

#: Words of names that identify no one, and name words that accounting terms use too.
FORM_WORDS = ["CTCP", "CT", "CP", "CONG", "TY", "CO", "PHAN", "TONG", "TNHH", "NGAN", "HANG", "TMCP", "VA", "CUA", "MTV"]
TERM_WORDS = ["DIEN", "LUC", "TAI", "CHINH", "DAU", "TU", "PHAT", "TRIEN", "XAY", "DUNG", "THUONG", "MAI", "DICH", "VU", "SAN", "XUAT", "VAN", "HANG", "TIEU", "DUNG"]

#: Brand names and former names of companies.
ALIASES = {
    "VIETCOMBANK": "VCB", "VIETINBANK": "CTG", "BIDV": "BID", "MBBANK": "MBB", "MB BANK": "MBB", "NGAN HANG QUAN DOI": "MBB",
    "VPBANK": "VPB", "SEABANK": "SSB", "HDBANK": "HDB", "OCEANBANK": "OGC", "EXIMBANK": "EIB", "SACOMBANK": "STB",
    "NAM A BANK": "NAB", "NAMABANK": "NAB", "KIENLONGBANK": "KLB", "KIEN LONG BANK": "KLB", "SAIGONBANK": "SGB",
    "VIETABANK": "VAB", "VIET A BANK": "VAB", "BAC A BANK": "BAB", "BACABANK": "BAB", "ABBANK": "ABB", "AN BINH BANK": "ABB",
    "MARITIME BANK": "MSB", "NCB": "NVB", "NGAN HANG QUOC DAN": "NVB", "SHBANK": "SHB", "PHUONG DONG": "OCB",
    "NGAN HANG A CHAU": "ACB", "EVN FINANCE": "EVF", "EVNFINANCE": "EVF", "VINAMILK": "VNM", "SUA VIET NAM": "VNM",
    "HOA PHAT": "HPG", "VINGROUP": "VIC", "VINCOM RETAIL": "VRE", "NOVALAND": "NVL", "DIA OC NO VA": "NVL", "VIETJET": "VJC",
    "PETROLIMEX": "PLX", "XANG DAU VIET NAM": "PLX", "SABECO": "SAB", "BAO VIET": "BVH", "MASAN CONSUMER": "MCH",
    "MASAN MEATLIFE": "MML", "MASAN HIGH-TECH": "MSR", "MASAN HIGH TECH": "MSR", "THE GIOI DI DONG": "MWG",
    "DIEN MAY XANH": "MWG", "VIGLACERA": "VGC", "GELEX": "GEX", "DIEN LUC GELEX": "GEE", "VINATEX": "VGT",
    "DET MAY VIET NAM": "VGT", "VINAFOR": "VIF", "LAM NGHIEP VIET NAM": "VIF", "VINAFOOD": "VSF", "LUONG THUC MIEN NAM": "VSF",
    "CAO SU VIET NAM": "GVR", "BINH SON": "BSR", "LOC HOA DAU": "BSR", "PV GAS": "GAS", "KHI VIET NAM": "GAS",
    "PV POWER": "POW", "DIEN LUC DAU KHI": "POW", "PVTRANS": "PVT", "VAN TAI DAU KHI": "PVT", "DAM PHU MY": "DPM",
    "DAM CA MAU": "DCM", "CANG HANG KHONG": "ACV", "DEO CA": "HHV", "SONADEZI": "SNZ", "BECAMEX IJC": "IJC",
    "HA TANG KY THUAT": "IJC", "KINH BAC": "KBC", "HOA SEN": "HSG", "NAM KIM": "NKG", "MINH PHU": "MPC", "DABACO": "DBC",
    "SAO MAI": "ASM", "HA DO": "HDG", "SAM HOLDINGS": "SAM", "TASCO": "HUT", "PHAT DAT": "PDR", "NAM LONG": "NLG",
    "VAN PHU": "VPI", "HAI PHAT": "HPX", "OCEAN GROUP": "OGC", "TAP DOAN DAI DUONG": "OGC", "SONG DA": "SJG",
    "KHAI HOAN LAND": "KHG", "SUNSHINE HOMES": "SSH", "CEN LAND": "CRE", "BAT DONG SAN THE KY": "CRE",
    "DUONG QUANG NGAI": "QNS", "VICEM HA TIEN": "HT1", "XI MANG HA TIEN": "HT1", "TRUONG THANH": "TTF",
    "AN PHAT XANH": "AAA", "NHUA AN PHAT": "AAA", "VICONSHIP": "VSC", "CONTAINER VIET NAM": "VSC", "DIEN GIA LAI": "GEG",
    "PROTRADE": "PRT", "BINH DUONG": "PRT", "HOANG ANH GIA LAI": "HAG", "HAGL AGRICO": "HNG", "DUC LONG GIA LAI": "DLG",
    "XAY DUNG HOA BINH": "HBC", "HOA BINH CORP": "HBC", "DAT XANH SERVICES": "DXS", "DICH VU BAT DONG SAN DAT XANH": "DXS",
    "DAT XANH GROUP": "DXG", "TAP DOAN DAT XANH": "DXG", "BLUEMARQ": "DXG", "PHU NHUAN": "PNJ", "HOANG HUY": "HHS",
    "DA NHIM": "DNH", "NHIET DIEN HAI PHONG": "HND", "DIEN LUC TKV": "DTK", "VIEN THONG FPT": "FOX", "FPT TELECOM": "FOX",
    "CHUNG KHOAN FPT": "FTS", "CHUNG KHOAN MB": "MBS", "CHUNG KHOAN SSI": "SSI", "NONG NGHIEP BAF": "BAF",
    "TAP DOAN F.I.T": "FIT", "TAP DOAN FIT": "FIT", "TAP DOAN C.E.O": "CEO", "DIA OC SAI GON THUONG TIN": "SCR", "TTC LAND": "SCR",
}

# --- ranking and answers -----------------------------------------------------------------------------------------------

#: Words that point to a section.
SECTION_HINTS = {
    "KQKD": ["DOANH THU", "GIA VON", "LOI NHUAN GOP", "LOI NHUAN THUAN", "LOI NHUAN TRUOC THUE", "LOI NHUAN SAU THUE", "CHI PHI BAN HANG", "CHI PHI QUAN LY", "CHI PHI TAI CHINH", "THU NHAP LAI", "LAI THUAN", "CHI PHI THUE", "EPS", "LAI CO BAN TREN CO PHIEU"],
    "LCTT": ["LUU CHUYEN TIEN", "DONG TIEN", "CFO", "TIEN THU TU", "TIEN CHI", "HOAT DONG DAU TU", "HOAT DONG TAI CHINH"],
    "CDKT": ["TONG TAI SAN", "TAI SAN NGAN HAN", "TAI SAN DAI HAN", "NO PHAI TRA", "NO NGAN HAN", "NO DAI HAN", "VON CHU SO HUU", "HANG TON KHO", "PHAI THU", "PHAI TRA", "TIEN VA TUONG DUONG TIEN", "TAI SAN CO DINH", "CHO VAY KHACH HANG", "TIEN GUI CUA KHACH HANG", "VON DIEU LE"],
    "VCSH": ["THAY DOI VON CHU SO HUU", "BIEN DONG VON"],
}

#: Words of little weight in labels, and pairs of phrases that contradict each other.
LABEL_STOP = ["CUA", "VA", "CAC", "CHO", "TRONG", "VOI", "THEO", "LA", "MOT", "NHUNG", "DEN", "TU", "TAI", "VE", "SO", "BANG", "GIUA", "MOI", "DUOC", "TREN", "NAM", "KY", "CUOI", "DAU", "TONG"]
ANTONYMS = [("NGAN HAN", "DAI HAN"), ("HUU HINH", "VO HINH"), ("PHAI THU", "PHAI TRA"), ("TRONG NUOC", "NUOC NGOAI")]

#: Columns of shares, of percentages and of notes.
COLUMN_SHARES = r"SO CO PHIEU|SO LUONG CO PHIEU|CO PHAN|SO LUONG"
COLUMN_PERCENT = r"TY LE|PHAN TRAM|%"
COLUMN_NOTE = r"THUYET MINH|MA SO|GHI CHU"

#: Expenses, in questions and labels.
EXPENSE = r"CHI PHI|GIA VON|LO |KHAU HAO|DU PHONG|THUE TNDN|TRICH LAP|GIAM TRU"

#: Named ratios: pattern, numerator, denominator, whether a percentage.
RATIOS = [
    (r"\bROE\b|TY SUAT (LOI NHUAN TREN )?VON CHU SO HUU", "LOI_NHUAN_SAU_THUE", "VON_CHU_SO_HUU", True),
    (r"\bROA\b|TY SUAT (LOI NHUAN TREN )?TONG TAI SAN", "LOI_NHUAN_SAU_THUE", "TONG_TAI_SAN", True),
    (r"BIEN LOI NHUAN GOP|TY LE LOI NHUAN GOP TREN DOANH THU|TY SUAT LOI NHUAN GOP", "LOI_NHUAN_GOP", "DOANH_THU_THUAN", True),
    (r"BIEN LOI NHUAN RONG|TY SUAT LOI NHUAN RONG|\bROS\b|BIEN LOI NHUAN SAU THUE|TY SUAT LOI NHUAN SAU THUE", "LOI_NHUAN_SAU_THUE", "DOANH_THU_THUAN", True),
    (r"BIEN LOI NHUAN (HOAT DONG|THUAN)", "LOI_NHUAN_THUAN_HDKD", "DOANH_THU_THUAN", True),
    (r"HE SO (KHA NANG )?THANH TOAN HIEN HANH|TY SO THANH TOAN HIEN HANH|TAI SAN NGAN HAN GAP BAO NHIEU LAN NO NGAN HAN", "TAI_SAN_NGAN_HAN", "NO_NGAN_HAN", False),
    (r"\bD/E\b|NO PHAI TRA TREN VON CHU SO HUU|HE SO NO TREN VON", "NO_PHAI_TRA", "VON_CHU_SO_HUU", False),
    (r"HE SO NO( PHAI TRA)? TREN TONG TAI SAN|TY LE NO TREN TONG TAI SAN", "NO_PHAI_TRA", "TONG_TAI_SAN", True),
    (r"VONG QUAY TONG TAI SAN|DOANH THU THUAN TREN TONG TAI SAN", "DOANH_THU_THUAN", "TONG_TAI_SAN", False),
    (r"VONG QUAY HANG TON KHO", "GIA_VON_HANG_BAN", "HANG_TON_KHO", False),
    (r"CFO ?/ ?LNST|LUU CHUYEN TIEN THUAN.*TREN LOI NHUAN SAU THUE|HE SO CHUYEN DOI LOI NHUAN", "LC_TIEN_THUAN_HDKD", "LOI_NHUAN_SAU_THUE", False),
    (r"CFO TREN DOANH THU|LUU CHUYEN TIEN THUAN.*TREN DOANH THU", "LC_TIEN_THUAN_HDKD", "DOANH_THU_THUAN", True),
    (r"TY LE CHI PHI BAN HANG TREN DOANH THU", "CHI_PHI_BAN_HANG", "DOANH_THU_THUAN", True),
    (r"TY LE CHI PHI QUAN LY.*TREN DOANH THU", "CHI_PHI_QUAN_LY_DOANH_NGHIEP", "DOANH_THU_THUAN", True),
    (r"TY TRONG HANG TON KHO TREN TONG TAI SAN", "HANG_TON_KHO", "TONG_TAI_SAN", True),
]

#: Nested clauses that closed formulas leave alone, and the heads of metrics.
NESTED = (
    r"TRONG NHOM|XET CAC|XET NHUNG|XET NHOM|TRONG SO (CAC )?|TRONG CAC DOANH NGHIEP|"
    r"(CAC|NHUNG|BON|BA|NAM|SAU|BAY)\s+(CONG TY|DOANH NGHIEP|DON VI|MA|NAM)[^,\.]{0,70}\bCO\b|"
    r"(TAI|O|VAO|CUA)\s+(DOANH NGHIEP|CONG TY|NAM|THOI DIEM|MA)[^,\.]{0,60}\bCO\b(?! PHAN)|"
    r"(TAI|VAO|O|DEN)\s+(NAM|THOI DIEM|DOANH NGHIEP|CONG TY)\s+MA\b|"
    r"\bNAM\s+MA\b|\bDOANH NGHIEP\s+MA\b|\bCONG TY\s+MA\b|"
    r"(?<!VIET )\bNAM\s+CO\b(?! PHAN)|\bDOANH NGHIEP\s+CO\b(?! PHAN)|"
    r"TRUNG VI|DUY TRI|LIEN TIEP|DONG LOAT|THEO KICH BAN|"
    r"\bNEU\b|GIA SU|GIA DINH|SAU KHI (GIAM|TANG|LOC)|"
    r"CAO HON|THAP HON|LON HON|NHO HON|VUOT QUA|"
    r"NGAY SAU|KE TIEP|DAU TIEN|LIEN TRUOC|TU DO"
)
METRIC_HEADS = ["DOANH THU", "GIA VON", "LOI NHUAN", "CHI PHI", "TAI SAN", "NO PHAI TRA", "NO NGAN HAN", "NO DAI HAN", "VON CHU SO HUU", "HANG TON KHO", "TIEN GUI", "LUU CHUYEN TIEN", "DONG TIEN", "VONG QUAY", "PHAI THU", "PHAI TRA", "CHO VAY", "VAY NGAN HAN", "VAY DAI HAN", "CO PHIEU", "KHAU HAO", "DU PHONG", "THUE", r"\bCFO\b", r"\bROE\b", r"\bROA\b", "BIEN LOI NHUAN", "HE SO", "TY SUAT", r"\bD/E\b"]
UNDIRECTED_DIFF = r"CHENH LECH|KHAC BIET|CHENH BAO NHIEU"
DIRECTED_DIFF = r"HIEU SO|TRU DI|TANG BAO NHIEU|GIAM BAO NHIEU|BIEN DONG|THAY DOI"
LEAST_WORDS = r"NHO NHAT|THAP NHAT|IT NHAT"

#: Fixed values: "A over B" and "A times B", and what is cut from their sides.
RATIO_OVER = r"^(.*?)\s+(?:TREN|CHIA CHO)\s+(.*)$"
RATIO_TIMES = r"^(.*?)\s+GAP(?:\s+BAO NHIEU)?\s+LAN\s+(.*)$"
RATIO_LEAD = r"^(TY LE|TY TRONG|TY SUAT|HE SO|BIEN|MUC|GIA TRI)\s+"
RATIO_TAIL = r"\s+(CUOI NAM|DAU NAM|CUOI KY|DAU KY|CUOI QUY|TRONG NAM|TRONG KY|TAI NGAY|DEN NGAY|VAO NGAY|TAI THOI DIEM|CUA)\b.*$"

#: Statement types by priority for each scope.
TYPE_PRIORITY = {
    "separate": ["separate", "other", "aggregated", "consolidated"],
    "consolidated": ["consolidated", "other", "aggregated", "separate"],
}
