"""License scan by ordered signature rules, in DataFrame operations only.

Texts are normalised to lower-case words joined by single blanks. Every rule is a regular expression over that form with
a keyword that must occur before the expression is tried, a priority (its place in the list) and a confidence. A text's
words are met once, as a set, with the first words of all keywords; only for those found are the keyword and then the rule
itself tried, by patterns that are constants of the plan and compiled once. Only rules that match look for their places, so
only their patterns are compiled for a row. Matches
become word intervals; an interval that lies inside another is suppressed, of equal intervals the rule that comes first
stays. Everything happens within a row, so the plan has no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases and labels that are always reported.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Per license: label | keyword | its name | its identifier | its address; all over normalised words. Every match of the name
#: holds the keyword: names that share none have lines of their own, without identifier and address.
FAMILIES = """
apache-2.0 | apache | apache (?:software )?licen[sc]e(?: version)?(?: 2(?: 0)?)?|apache 2(?: 0)? licen[sc]e | apache 2 0 | apache org licenses license 2 0
apache-1.1 | apache | apache software licen[sc]e version 1 1|apache licen[sc]e 1 1 | apache 1 1 | apache org licenses license 1 1
mit | mit | mit licen[sc]e|mit style licen[sc]e | mit | opensource org licenses mit(?: license)?
mit | expat | expat licen[sc]e
mit-0 | mit | mit no attribution(?: licen[sc]e)? | mit 0 | opensource org licenses? mit 0
bsd-2-clause | bsd | (?:simplified|2 clause|two clause|freebsd) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)? | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)? | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)? | bsd 4 clause | directory fsf org wiki license bsd 4clause
bsd-0-clause | bsd | (?:zero clause|0 clause) bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)? | 0bsd | opensource org licenses? 0bsd
bsd | bsd | bsd (?:style )?licen[sc]e | bsd | opensource org licenses bsd license
gpl-1.0 | gnu | gnu general public licen[sc]e(?: version| v)? 1|gnu gpl ?v?1 | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2.0 | gnu | gnu general public licen[sc]e(?: version| v)? 2|gnu gpl(?: version)? v?2 | gpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gnu | gnu general public licen[sc]e(?: version| v)? 3|gnu gpl(?: version)? v?3 | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
gpl-3.0 | gplv3 | gplv3
gpl | gnu | gnu general public licen[sc]e|gnu gpl | gpl | gnu org licenses gpl(?: html)?
lgpl-2.0 | gnu | gnu library general public licen[sc]e(?: version 2)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | gnu | gnu lesser general public licen[sc]e(?: version| v)? 2 1|gnu lgpl v?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu | gnu lesser general public licen[sc]e(?: version| v)? 3|gnu lgpl v?3 | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl | gnu | gnu lesser general public licen[sc]e|gnu lgpl | lgpl | gnu org licenses lgpl(?: html)?
agpl-3.0 | affero | (?:gnu )?affero general public licen[sc]e(?: version 3| v3)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
agpl-1.0 | affero | affero general public licen[sc]e version 1 | agpl 1 0 | affero org oagpl
gfdl | gnu | gnu free documentation licen[sc]e(?: version 1 [0-3])? | gfdl 1 [1-3](?: only| or later)? | gnu org (?:copyleft|licenses) fdl
mpl-1.1 | mozilla | mozilla public licen[sc]e(?: version)? 1 1 | mpl 1 1 | mozilla org mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[sc]e(?:(?: version)? 2 0)? | mpl 2 0 | mozilla org mpl 2 0
epl-1.0 | eclipse | eclipse public licen[sc]e(?: version| v)? 1 0 | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse | eclipse public licen[sc]e(?:(?: version| v)? 2 0)? | epl 2 0 | eclipse org legal epl (?:v20|2 0)
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?: version 1 0)? | edl 1 0 | eclipse org org documents edl v10
cddl-1.0 | common development | common development and distribution licen[sc]e(?: version 1 0)? | cddl 1 0 | opensource org licenses cddl1?
cpl-1.0 | common public | common public licen[sc]e(?: version 1 0)? | cpl 1 0 | opensource org licenses cpl1 0
cpal-1.0 | common public | common public attribution licen[sc]e(?: version 1 0)? | cpal 1 0 | opensource org licenses cpal 1 0
ms-pl | microsoft | microsoft public licen[sc]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft | microsoft reciprocal licen[sc]e | ms rl | opensource org licenses ms rl
isc | isc | isc licen[sc]e | isc | opensource org licenses isc
zlib | zlib | zlib (?:libpng )?licen[sc]e | zlib | zlib net zlib license
libpng | libpng | libpng licen[sc]e(?: version 2)? | libpng(?: 2 0)? | libpng org pub png src libpng license
boost-1.0 | boost | boost software licen[sc]e(?: version 1 0)? | bsl 1 0 | boost org license 1 0
artistic-1.0 | artistic | (?:perl )?artistic licen[sc]e 1 0 | artistic 1 0(?: perl)? | opensource org licenses artistic 1 0
artistic-2.0 | artistic | (?:perl )?artistic licen[sc]e(?: 2 0)? | artistic 2 0 | opensource org licenses artistic 2 0
python-2.0 | python | python software foundation licen[sc]e(?: version 2)? | (?:python|psf) 2 0 | docs python org 3 license
python-2.0 | psf | psf licen[sc]e
ruby | ruby | ruby licen[sc]e | ruby | ruby lang org en about license
php-3.01 | php | php licen[sc]e(?: version 3 01?)? | php 3 01 | php net license 3 01
postgresql | postgresql | postgresql licen[sc]e | postgresql | postgresql org about licence
unlicense | unlicen | the unlicen[sc]e|unlicen[sc]ed? public domain | unlicense | unlicense org
wtfpl | wtfpl | wtfpl(?: licen[sc]e)? | wtfpl | wtfpl net
wtfpl | do what the | do what the [a-z]+ you want to public licen[sc]e
x11 | x11 | x11 licen[sc]e | x11 | xfree86 org 3 3 6 copyright2
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[sc]e | ncsa | otm illinois edu uiuc openSource
upl-1.0 | universal | universal permissive licen[sc]e(?: version 1 0)? | upl 1 0 | opensource org licenses upl
eupl-1.2 | european union | european union public licen[sc]e(?: version)?(?: v?1 [12])? | eupl 1 [12] | joinup ec europa eu page eupl text
osl-3.0 | open software | open software licen[sc]e(?: version| v)?(?: 3 0)? | osl 3 0 | opensource org licenses osl 3 0
afl-3.0 | academic free | academic free licen[sc]e(?: version| v)?(?: 3 0)? | afl 3 0 | opensource org licenses afl 3 0
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?: version 1 1)? | ofl 1 1 | scripts sil org ofl
vim | vim | vim licen[sc]e | vim | vimdoc sourceforge net htmldoc uganda
openssl | openssl | openssl licen[sc]e | openssl | openssl org source license
curl | curl | curl licen[sc]e | curl | curl se docs copyright
bsl-1.1 | business source | business source licen[sc]e(?: 1 1)? | busl 1 1 | mariadb com bsl11
sspl-1.0 | server side | server side public licen[sc]e(?: version 1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic licen[sc]e(?: 2 0| v2)? | elastic 2 0 | elastic co licensing elastic license
commons-clause | commons clause | commons clause(?: licen[sc]e)?(?: condition)?(?: v1 0)? | commons clause | commonsclause com
polyform | polyform | polyform (?:noncommercial|shield|strict|small business) licen[sc]e(?: 1 0 0)? | polyform [a-z]+ 1 0 0 | polyformproject org licenses
odbl-1.0 | open database | open (?:data commons open )?database licen[sc]e(?: v?1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by | open data commons | open data commons attribution licen[sc]e | odc by(?: 1 0)? | opendatacommons org licenses by
pddl-1.0 | public domain dedication | public domain dedication and licen[sc]e | pddl 1 0 | opendatacommons org licenses pddl
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? | cc0 1 0 | creativecommons org publicdomain zero
cc-by-nc-nd | nc nd | cc by nc nd(?: [1-4] [05])? | cc by nc nd [1-4] [05] | creativecommons org licenses by nc nd
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa | nc sa | cc by nc sa(?: [1-4] [05])? | cc by nc sa [1-4] [05] | creativecommons org licenses by nc sa
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc | by nc | cc by nc(?: [1-4] [05])? | cc by nc [1-4] [05] | creativecommons org licenses by nc
cc-by-nc | creative commons | creative commons attribution non ?commercial
cc-by-nd | by nd | cc by nd(?: [1-4] [05])? | cc by nd [1-4] [05] | creativecommons org licenses by nd
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | by sa | cc by sa(?: [1-4] [05])? | cc by sa [1-4] [05] | creativecommons org licenses by sa
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by | cc by | cc by(?: [1-4] [05])? | cc by [1-4] [05] | creativecommons org licenses by
creative-commons | creative commons | creative commons(?: attribution)?(?: licen[sc]e)? | cc | creativecommons org licenses
open-rail | rail | (?:creativeml )?open ?rail(?: m)?(?: licen[sc]e)? | openrail | huggingface co spaces bigscience license
proprietary | proprietary | proprietary and confidential|proprietary licen[sc]e | licenseref proprietary | licenseref com proprietary
""".strip()

#: Single rules: label | keyword | expression | confidence.
SINGLES = """
reserved | all rights | all rights (?:are )?(?:hereby )?reserved(?: worldwide)? | 0.9
reserved | some rights | some rights reserved | 0.6
reserved | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: or [a-z]+)? (?:of [a-z ]{1,40} )?(?:is )?(?:strictly )?prohibited | 0.9
reserved | no part of this | no part of this (?:publication|work|document|book) may be (?:reproduced|copied|distributed) | 0.95
reserved | may not be | may not be (?:reproduced|copied|redistributed|published) without (?:prior )?(?:written )?(?:permission|consent) | 0.9
copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})* | 0.7
copyright | copyrighted | copyrighted (?:material|work) | 0.6
public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain | 0.9
public-domain | public domain | (?:is|are) in the public domain | 0.7
gpl | general public | (?:terms of )?(?:the )?general public licen[sc]e | 0.8
gpl | gpl | (?:the )?gpl licen[sc]e|licensed under (?:the )?gpl | 0.8
lgpl | lgpl | (?:the )?lgpl licen[sc]e|licensed under (?:the )?lgpl | 0.8
mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy | 1.0
isc | permission to use | permission to use copy modify and or distribute this software for any purpose | 1.0
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted | 1.0
bsd-3-clause | neither the name | neither the name of [a-z0-9 ]{1,60} nor the names of its contributors | 1.0
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software | 1.0
gpl | free software | this program is free software you can redistribute it and or modify it | 1.0
gpl | without any warranty | distributed in the hope that it will be useful but without any warranty | 0.9
warranty | as is | (?:provided|distributed|supplied) (?:on an )?as is(?: basis)?(?: without warrant(?:y|ies))? | 0.6
zlib | altered source | altered source versions must be plainly marked as such | 1.0
other-permissive | free for any use | free for any use | 0.5
other-permissive | free to use copy | free to use copy and modify | 0.5
other-noncommercial | non commercial | (?:for )?non commercial (?:use|purposes) only | 0.7
mit | above copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | 1.0
mit | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software | 1.0
mit | authors or copyright holders be liable | in no event shall the authors or copyright holders be liable for any claim damages or other liability | 0.9
mit-0 | furnished to do so the software is | permit persons to whom the software is furnished to do so the software is provided as is | 0.7
apache-2.0 | in compliance with the license | you may not use this file except in compliance with the license | 1.0
apache-2.0 | agreed to in writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | 1.0
apache-2.0 | perpetual worldwide | perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except as stated in this section patent) licen[sc]e | 0.95
apache-2.0 | limitations under the license | see the license for the specific language governing permissions and limitations under the license | 1.0
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation | 0.9
bsd-2-clause | source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | 0.9
bsd-2-clause | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution | 0.9
bsd-2-clause | views and conclusions | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies | 0.95
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission | 0.95
bsd-4-clause | following acknowledgement | must display the following acknowledgement this product includes software developed by [a-z0-9 ]{1,60} | 0.9
bsd | as is and any express | this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties | 0.9
bsd-0-clause | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | 1.0
isc | with or without fee is hereby granted | with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | 1.0
isc | author disclaims all warranties | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness | 0.9
gpl | any later version | either version [1-3](?: 0)? of the license or at your option any later version | 0.9
gpl-2.0 | version 2 of the license | published by the free software foundation either version 2 of the license | 1.0
gpl-3.0 | version 3 of the license | published by the free software foundation either version 3 of the license | 1.0
gpl | received a copy of the gnu general | you should have received a copy of the gnu general public licen[sc]e along with this (?:program|library|software) | 0.95
gpl | comes with absolutely no warranty | comes with absolutely no warranty(?: for details type show w)? | 0.8
gpl | welcome to redistribute | this is free software and you are welcome to redistribute it under certain conditions | 0.9
gpl | copyleft | (?:strong )?copyleft licen[sc]e | 0.5
lgpl | received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:program|library|software) | 0.95
lgpl | this library is free software | this library is free software you can redistribute it and or modify it | 1.0
lgpl | lesser general public license as published | under the terms of the gnu lesser general public license as published by the free software foundation | 0.95
agpl-3.0 | remote network interaction | remote network interaction use with the gnu general public license | 0.95
agpl-3.0 | affero general public license as published | under the terms of the gnu affero general public license as published by the free software foundation | 1.0
gfdl | invariant sections | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts | 1.0
mpl-2.0 | this source code form | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0 | 1.0
mpl-2.0 | mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at | 0.95
mpl-2.0 | incompatible with secondary | this source code form is incompatible with secondary licenses | 0.9
mpl-1.1 | contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1 | 1.0
epl-2.0 | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?)? 2 0 | 1.0
epl-1.0 | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? 1 0 | 1.0
cddl-1.0 | common development and distribution license the license | subject to the terms of the common development and distribution license the license | 1.0
boost-1.0 | machine executable object code | works are solely in the form of machine executable object code generated by a source language processor | 1.0
boost-1.0 | distributed under the boost | distributed under the boost software license version 1 0 | 1.0
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software | 1.0
zlib | without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable | 0.95
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain | 1.0
unlicense | jurisdictions that recognize | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest | 1.0
wtfpl | you just do what | you just do what the [a-z]+ you want to | 0.95
cc0-1.0 | related or neighboring | (?:waived|waiving|waives) all copyright and related or neighboring rights | 0.9
cc0-1.0 | with this deed | the person who associated a work with this deed has dedicated the work to the public domain | 1.0
cc-by | give appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made | 0.8
cc-by-sa | same license as the original | you must distribute your contributions under the same license as the original | 0.85
cc-by-nc | material for commercial purposes | you may not use the material for commercial purposes | 0.85
cc-by-nd | distribute the modified material | you may not distribute the modified material | 0.85
ofl-1.1 | reserved font name | with reserved font name[a-z0-9 ]{0,40} | 0.9
ofl-1.1 | font software | this font software is licensed under the sil open font license | 1.0
artistic-2.0 | standard version of th | (?:source form of )?the standard version of (?:this|the) package | 0.8
python-2.0 | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license | 1.0
php-3.01 | products derived from this software may not be called php | products derived from this software may not be called php | 0.95
postgresql | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | 1.0
ncsa | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers | 0.95
ms-pl | each contributor grants you a non exclusive | each contributor grants you a non exclusive worldwide royalty free (?:copyright|patent) license | 0.9
x11 | name of the x consortium | the name of the x consortium shall not be used in advertising | 1.0
openssl | openssl project | developed by the openssl project for use in the openssl toolkit | 1.0
sspl-1.0 | make the functionality of the program | if you make the functionality of the program or a modified version available to third parties as a service | 0.95
commons-clause | without limiting other conditions in the license | without limiting other conditions in the license the grant of rights under the license will not include | 1.0
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service | 1.0
bsl-1.1 | change license | (?:on the )?change date(?: or the fourth anniversary)? [a-z0-9 ]{0,60}change license | 0.9
open-rail | use based restrictions | use based restrictions(?: as referenced)?(?: in paragraph 5)? | 0.8
odbl-1.0 | database is made available under the | this [a-z0-9 ]{0,40}database is made available under the open database license | 1.0
odc-by | any rights in individual contents | any rights in individual contents of the database are licensed under the database contents license | 0.9
warranty | merchantability | (?:without even the )?implied warrant(?:y|ies) of merchantability(?: and| or) fitness for a particular purpose | 0.7
warranty | no event shall | in no event shall [a-z0-9 ]{1,80} be liable for any direct indirect incidental special exemplary or consequential damages | 0.8
warranty | entire risk | the entire risk as to the quality and performance of the (?:program|software) is with you | 0.8
patent | patent | (?:grants? you|hereby grants) a (?:[a-z0-9 ]{0,80} )?patent licen[sc]e | 0.6
attribution | attribution | (?:free to use|use permitted|may be used) with (?:proper )?attribution | 0.5
other-noncommercial | personal | (?:for )?personal(?: and non ?commercial)? use only | 0.6
other-noncommercial | evaluation purposes | for (?:internal )?evaluation purposes only | 0.6
other-proprietary | trade secret | (?:contains|constitutes) (?:confidential (?:information )?and )?(?:proprietary )?trade secrets? | 0.8
other-proprietary | confidential and proprietary | confidential and proprietary(?: information)?(?: of [a-z0-9 ]{1,40})? | 0.7
other-proprietary | end user licen | (?:this )?end user licen[sc]e(?: agreement)? | 0.7
other-proprietary | reverse engineer | (?:may not|shall not|agree not to) (?:copy modify )?(?:decompile )?(?:or )?reverse engineer | 0.7
reserved | reproduced in any form | may (?:not )?be reproduced in any form(?: or by any means)?(?: without [a-z ]{1,40}permission)? | 0.8
reserved | redistribution prohibited | redistribution prohibited(?: without permission)? | 0.8
reserved | permission of the publisher | without (?:the )?(?:prior )?(?:written )?permission of the publisher | 0.9
copyright | copyright holder | (?:the )?copyright holders?(?: and contributors)? | 0.4
other-license | licen | licen[sc]ed under [a-z0-9]+ | 0.3
other-license | licen | see (?:the )?(?:file )?licen[sc]e(?: txt| md)?(?: file)? for (?:details|more) | 0.4
""".strip()


#: Keywords that are part of a longer word in some matches: these are looked for in the whole text.
PARTIAL = ("licen", "unlicen", "rail")


def anchor(key: str) -> str | None:
    """A word that every match of a rule with this keyword holds; None for keywords that are not whole words."""
    *whole, last = key.split()
    return max(whole, key=len) if whole else None if last in PARTIAL else last


def rules() -> list[tuple[str, str, str, float]]:
    """(label, keyword, expression, confidence), first the most telling forms."""
    families = [([x.strip() for x in line.split(" | ")] + ["", ""])[:5] for line in FAMILIES.splitlines()]
    grant = r"(?:licen[sc]ed|released|distributed|published|available|provided|covered)(?: and [a-z]+)?(?: to you)? (?:under|by)(?: the)?(?: terms of)?(?: the)?"
    out = [(label, "spdx", f"spdx licen[sc]e identifier (?:{ident})", 1.0) for label, _, _, ident, _ in families if ident]
    out += [(label, key, f"{grant} (?:{name})", 1.0) for label, key, name, _, _ in families]
    out += [(label, " ".join(address.split()[:2]), f"(?:https? )?(?:www )?{address.lower()}", 0.95) for label, _, _, _, address in families if address]
    out += [(label, key, name, 0.8) for label, key, name, _, _ in families]
    out += [(a, b, c, float(d)) for a, b, c, d in ([x.strip() for x in line.split(" | ")] for line in SINGLES.splitlines())]
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(text: Column) -> Column:
    """Lower-cased (A-Z) words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, joined by single blanks."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _places(norm: Column, expression: Column) -> Column:
    """Array of (start, end) in words, end exclusive, of the places where the expression matches whole words.

    Matches get a mark before and after, which no normalised text has, and the marked words' numbers are the places.
    """
    marked = F.regexp_replace(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )")), F.lit("\x01$0\x02"))

    def at(words: Column, mark: Column, plus: int) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(mark(w), i + plus)), lambda i: i.isNotNull())

    def zipped(words: Column) -> Column:
        starts = at(words, lambda w: w.startswith("\x01"), 0)
        ends = at(words, lambda w: w.endswith("\x02"), 1)
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end")))

    return let(F.split(F.trim(marked), " "), zipped)


_SPAN = "array<struct<start:bigint,stop:bigint,priority:int,label:string,confidence:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, base (array of start, end, label), detections (start, end, priority, label,
    confidence of those that are not suppressed, by start).

    docs: doc_id, text; other columns are ignored. Null and empty texts have no words and no places. Repeated rows give
    repeated rows, an empty table none.
    """
    table = rules()
    norm = F.col("norm")
    words = F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")

    def labelled(phrase: str, label: str) -> Column:
        places = F.transform(_places(norm, F.lit(phrase)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label")))
        return F.when(norm.contains(phrase), places).otherwise(none)

    base = F.concat(*[labelled(p, a) for p, a in BASE])

    # Per keyword, if the text holds it: the rules that match, found by patterns that are constants of the plan.
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    nothing = F.array().cast("array<struct<priority:int,label:string,expression:string,confidence:double>>")
    by_key: dict[str, list[int]] = {}
    for i, (_, key, _, _) in enumerate(table):
        by_key.setdefault(key, []).append(i)

    def fits(i: int) -> Column:
        label, _, expression, confidence = table[i]
        rule = F.struct(F.lit(i).alias("priority"), F.lit(label).alias("label"), F.lit(expression).alias("expression"), F.lit(confidence).alias("confidence"))
        return F.when(padded.rlike(f"(?<= )(?:{expression})(?= )"), rule)

    def gate(key: str) -> Column:
        word = anchor(key)
        return norm.contains(key) if word is None else F.array_contains("present", word) & norm.contains(key)

    matching = F.concat(*[F.when(gate(key), F.array_compact(F.array(*map(fits, own)))).otherwise(nothing) for key, own in by_key.items()])
    anchors = F.array(*map(F.lit, sorted({w for k in by_key if (w := anchor(k)) is not None})))

    def found(tried: Column) -> Column:
        return F.flatten(F.transform(tried, lambda r: F.transform(_places(norm, r["expression"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("stop"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))

    # By start, longest first, then by priority: whatever does not reach beyond all before it lies inside one of them.
    start = F.struct(F.lit(-1).cast("long").alias("reach"), F.array().cast(_SPAN).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        return F.when(-d["stop"] <= acc["reach"], acc).otherwise(F.struct((-d["stop"]).alias("reach"), F.concat(acc["kept"], F.array(d)).alias("kept")))

    kept = F.aggregate(F.sort_array(F.coalesce(let(matching, found), F.array().cast(_SPAN))), start, step, lambda acc: acc["kept"])
    detections = F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return texts.select("doc_id", "norm", F.array_intersect(F.split("norm", " "), anchors).alias("present")).select("doc_id", words.alias("n_words"), base.alias("base"), detections.alias("detections"))


def license_report(scanned: DataFrame) -> DataFrame:
    """Digest of scan_licenses: counts, first and last base place, labels and the highest confidence (0 without any)."""
    base, found = F.col("base"), F.col("detections")
    starts = F.transform(base, lambda x: x["start"])
    mine = F.array_distinct(F.transform(base, lambda x: x["label"]))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    base_score = F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(mine).alias("base_labels"),
        joined(F.array_union(mine, F.transform(found, lambda x: x["label"]))).alias("labels"),
        F.greatest(base_score, F.coalesce(F.array_max(F.transform(found, lambda x: x["confidence"])), F.lit(0.0))).alias("score"),
        F.size(found).cast("long").alias("n_detections"),
    )
