"""A library of invented but plausible names, by group and gender; it can be exported, changed and loaded as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

ENV_VAR = "TESSERA_NAMES"
GENDERS = ("male", "female")

#: Groups: first parts of names, male and female endings, first parts and endings of surnames (gendered ones after a bar).
#: All names are made from these by rule.
GROUPS = {
    "anglo": ("Al Ed Har Wil Mar Row", "bert win ley", "ma ith leen", "Ash Brad Hart Whit", "field ford well"),
    "french": ("Adr Ant Fab Lu Mar Gab", "ien oine ice", "ienne ette iane", "Beau Char Lam Mont", "champ pentier ier"),
    "german": ("Die Her Lud Ott Wal Rein", "mar bert wig", "linde gard traud", "Berg Holz Stein Wald", "mann bach hauer"),
    "italian": ("Al Ben Gio Lor Mar Vit", "erto enzo iano", "erta enza iana", "Bel Cas Ros Mont", "lini etti ari"),
    "hispanic": ("Al Cris Fer Mar Rod Val", "fonso tino nando", "fonsa tina nanda", "Cas Gon Mar Vel", "tillo zales quez"),
    "brazilian": ("Ca Fla Lu Mar Re Tia", "vio ciano nato", "via ciana nata", "Al Car Mo Sil", "meida valho veira"),
    "scandinavian": ("As Bjo Gun Ing Sig Tor", "bjorn mund var", "bjorg hild run", "Ander Lind Nor Berg", "sen strom gren"),
    "russian": ("Al Bor Dmi Iva Ser Vik", "islav tri gei", "islava tria geya", "Ivan Petr Sokol Vol", "ov|ova in|ina ev|eva"),
    "polish": ("Bog Kaz Lesz Mir Sta Woj", "dan imir ek", "dana imira ka", "Kowal Lewan Nowa Wis", "ski|ska cki|cka wicz"),
    "greek": ("Al Dim Kon Nik The Va", "exios itris odoros", "exia itra odora", "Papa Kara Dou Sta", "dakis poulos nidis"),
    "turkish": ("Ah Em Ha Me Os Se", "met rah kan", "mine rine lin", "Ak Dem Kay Yil", "can iroglu maz"),
    "persian": ("Ar Bah Far Kam Mehr Sha", "ash ram zad", "naz row zadeh", "Ahma Hos Kar Rez", "di eini imi"),
    "arab_levantine": ("Kha Mah Na Sa Wa Ra", "lid dir mi", "lida dira mia", "Al-Ha Al-Kha Had Nas", "dad tib ser"),
    "chinese": ("Bo Jian Li Wei Xiao Yu", " hao  ming  jun", " fang  lan  mei", "Ch L W Zh", "en i ang"),
    "japanese": ("Aki Haru Ken Masa Nao Yu", "ro shi to", "ka ko mi", "Fuji Kawa Mori Yama", "moto saki ta"),
    "korean": ("Dong Ha Ji Min Seo Young", "-ho -jun -seok", "-ah -eun -hee", "B K P Y", "ae im ang"),
    "vietnamese": ("An Bao Duc Hung Minh Tuan", " Kiet  Long  Phong", " Chi  Lan  Mai", "D L N Tr", "ang inh guyen"),
    "indian_north_hindu": ("Aj Dev Kir Raj San Vij", "ay endra esh", "ita ini eshwari", "Agar Cha Gup Shar", "wal turvedi ta"),
    "indian_tamil": ("Ar Kart Mur Sel Sund Vel", "ul ikeyan ugan", "uli ikeya ugavi", "Chin Nata Pal Sub", "raman rajan aniswamy"),
    "indian_punjabi_sikh": ("Bal Gur Har Jas Man Sukh", "winder preet deep", "winderjit preetam deepa", "Dhil Gre Sid Sand", "lon wal hu"),
    "yoruba": ("Ade Ayo Ba Fo Olu Tun", "bayo dele tunde", "bisi nike sola", "Ade Afo Oye Ogun", "bayo labi wale"),
    "igbo": ("Chi Eme Ike Ngo Obi Uche", "chukwu nna kenna", "ma oma nne", "Eze Nwa Oka Ugo", "chukwu for ndu"),
    "ethiopian": ("Abe Deb Get Ha Mek Tes", "be achew onnen", "bech est rit", "Alem Bek Gir Tad", "ayehu ele ese"),
    "algerian": ("Aba Kad Mou Nou Sli Tah", "dir rad nir", "dia ria nia", "Ben Bou Had Zer", "ali diaf kacem"),
    "ghanaian_akan": ("Kwa Ko Ya Fi Kwe Agye", "bena fi me", "sia wa baa", "Asa Boa Men Owu", "nte teng sah"),
    "indian_bengali_hindu": ("Am Bi Deb Pro Su Tap", "it ash endu", "ita oshi ali", "Bha Cha Mukh Sen", "ttacharya kraborty gupta"),
    "indian_bengali_muslim": ("Ab Has Mah Raf Sha Tan", "ul ir mud", "ina ima ida", "Cho Khan Mia Sar", "wdhury dakar ker"),
    "indian_gujarati": ("Bha Dha Hit Jay Man Nil", "vesh esh ubhai", "vna ika ben", "Des Me Pa Vya", "ai hta tel"),
    "indonesian": ("Bud Dar Har Sur Tri Wid", "iman to yono", "ianti ningsih yani", "Har Kus Pra Wi", "tono uma jaya"),
    "moroccan": ("Ay Hic Jam Mou Ras Yas", "oub ham sine", "ouba hama sina", "El Ben Bou Tah", "amrani jelloun iri"),
    "rwandan": ("Ga Ha Ka Mu Nda Uwi", "bo rera gabo", "mana teta mariya", "Ha Ka Mu Ni", "bimana yonga yizigiro"),
    "sudanese": ("Ab Ham Has Mub Om Sid", "delrah id arak", "dela ida araka", "El Kha Os Sul", "hassan tim man"),
    "filipino": ("An Ben Dan Jo Ro Vir", "gelo ilo gilio", "gela ilda ginia", "Baut Del Mag San", "ista osario tos"),
}

#: Middle names (fixed values).
MIDDLE = ("Ann", "Blake", "Clay", "Dale", "Eve", "Fay", "Gale", "Hope", "Ines", "Jay", "Kim", "Lou", "Mae", "Noel", "Oak", "Page", "Quin", "Rae", "Sky", "True", "Una", "Val", "Wynn", "Yves", "Zoe")


@dataclass
class NameLibrary:
    """Names by key: {group}_{gender} for first names, {group} or {group}_{gender} for surnames."""

    first: dict[str, list[str]]
    last: dict[str, list[str]]
    middle: list[str]

    @classmethod
    def built_in(cls) -> NameLibrary:
        first, last = {}, {}
        for group, (stems, male, female, roots, ends) in GROUPS.items():
            for gender, endings in (("male", male), ("female", female)):
                first[f"{group}_{gender}"] = [a + b for a in stems.split() for b in _endings(endings)]
            gendered = "|" in ends
            for i, gender in enumerate(GENDERS) if gendered else ((0, None),):
                key = f"{group}_{gender}" if gender else group
                last[key] = [a + b.split("|")[min(i, b.count("|"))] for a in roots.split() for b in ends.split()]
        return cls(first, last, list(MIDDLE))

    @property
    def groups(self) -> list[str]:
        return list(dict.fromkeys(_group(k) for k in self.first))

    def _pool(self, table: dict[str, list[str]], keep) -> list[str]:
        chosen = [n for k, names in table.items() if keep(k) for n in names]
        return list(dict.fromkeys(chosen or [n for names in table.values() for n in names]))

    def first_names(self, gender: str | None = None, ethnicity: str | None = None) -> list[str]:
        """Of a gender (None: both) and group or family of groups; of all where nothing fits."""
        return self._pool(self.first, lambda k: (gender not in GENDERS or k.endswith("_" + gender)) and _fits(k, ethnicity))

    def last_names(self, gender: str | None = None, ethnicity: str | None = None) -> list[str]:
        """Like first names; the other gender's forms of a surname are left out."""
        other = {"male": "_female", "female": "_male"}.get(gender or "")
        return self._pool(self.last, lambda k: not (other and k.endswith(other)) and _fits(k, ethnicity))

    def export(self, path: str | None = None) -> str:
        """The library as JSON, written to path if one is given."""
        text = json.dumps({"first": self.first, "last": self.last, "middle": self.middle}, indent=2, ensure_ascii=False)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text

    @classmethod
    def load(cls, source: str | dict) -> NameLibrary:
        """From a dict, JSON text, a JSON file or a Parquet file of (part, key, name); nothing in it is run."""
        if isinstance(source, str) and source.endswith(".parquet"):
            import pyarrow.parquet

            table: dict = {"first": {}, "last": {}, "middle": []}
            for r in pyarrow.parquet.read_table(source, columns=["part", "key", "name"]).to_pylist():
                table["middle"].append(r["name"]) if r["part"] == "middle" else table[r["part"]].setdefault(r["key"], []).append(r["name"])
            source = table
        if isinstance(source, str):
            if not source.lstrip().startswith("{"):
                with open(source, encoding="utf-8") as f:
                    source = f.read()
            source = json.loads(source)
        for part in ("first", "last"):
            table = source.get(part)
            if not isinstance(table, dict) or not table or not all(isinstance(v, list) and v for v in table.values()):
                raise ValueError(f"a name library needs names under {part!r}")
        return cls(source["first"], source["last"], list(source.get("middle") or MIDDLE))


def _endings(text: str) -> list[str]:
    """Endings by blanks; one that begins with a blank (two blanks in the text) is a word of its own."""
    return [(" " + e) for e in text.split()] if text.startswith(" ") else text.split()


def _group(key: str) -> str:
    for g in GENDERS:
        key = key.removesuffix("_" + g)
    return key


def _fits(key: str, ethnicity: str | None) -> bool:
    return ethnicity is None or _group(key).startswith(ethnicity)


_current: NameLibrary | None = None


def library() -> NameLibrary:
    """The library in use: the one set, else the file that the environment names, else the built-in one."""
    global _current
    if _current is None:
        path = os.environ.get(ENV_VAR)
        _current = NameLibrary.load(path) if path else NameLibrary.built_in()
    return _current


def use_library(source: str | dict | NameLibrary | None) -> NameLibrary:
    """Set the library for this process; None goes back to the default."""
    global _current
    _current = source if source is None or isinstance(source, NameLibrary) else NameLibrary.load(source)
    return library()
