"""Hand-written licence signatures.

A line is ``licence | kind | keywords | regex``. A space in a regex stands for
any run of white space and comment marks. A rule is tried only in texts that
hold one of its keywords (lower case, separated by commas). Kinds, by falling
priority: ``tag`` (machine-readable), ``text`` (a phrase of the licence itself),
``notice`` (a grant), ``name`` (a mention by name), ``hint``.
"""

PRIORITY = {"tag": 5, "text": 4, "notice": 3, "name": 2, "hint": 1}

RULES = r"""
Apache-2.0 | notice | apache | licen[sc]ed under (?:the )?apache licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
Apache-2.0 | notice | apache | (?:released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
Apache-2.0 | text | apache.org | you may obtain a copy of the licen[sc]e at https?://(?:www\.)?apache\.org/licenses/license-2\.0
Apache-2.0 | text | apache | apache licen[sc]e version 2\.0, january 2004
Apache-2.0 | text | contributor hereby grants | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) licen[sc]e
Apache-2.0 | name | apache | apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
Apache-2.0 | name | apache-2.0,apache 2.0 | \bapache[- ]2\.0\b
Apache-1.1 | name | apache | apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?1\.1\b
Apache-1.1 | text | apache software foundation | this product includes software developed by the apache software foundation
Apache-1.0 | name | apache | apache(?: software)? licen[sc]e,? ?(?:version|v\.?)? ?1\.0\b
Apache-1.0 | text | apache group | this product includes software developed by the apache group
MIT | notice | mit | (?:released|distributed|licen[sc]ed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?mit[- ]licen[sc]e\b
MIT | notice | mit | (?:released|distributed|licen[sc]ed|available) under (?:the )?mit\b
MIT | text | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | text | the software is provided | the software is provided "?as is"?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
MIT | name | mit | \b(?:the )?mit[- /](?:x11 )?licen[sc]e\b
MIT | name | expat | \bexpat licen[sc]e\b
MIT | hint | mit | licen[sc]e ?: ?"?mit\b
MIT-0 | name | mit no attribution,mit-0 | \bmit(?: no attribution|-0)\b(?: licen[sc]e)?
X11 | name | x11 | \bx11 licen[sc]e\b
X11 | text | x consortium | except as contained in this notice, the name of the x consortium shall not be used
ISC | notice | isc | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?isc licen[sc]e\b
ISC | text | permission to use | permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted, provided that
ISC | name | isc | \bisc licen[sc]e\b
0BSD | name | 0bsd,zero-clause,zero clause | \b(?:0bsd|(?:bsd )?zero[- ]clause(?: bsd)?)(?: licen[sc]e)?\b
0BSD | text | permission to use | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\. the software
BSD-2-Clause | name | bsd | \b(?:2|two)[- ]clause bsd(?: licen[sc]e)?\b
BSD-2-Clause | name | bsd | \bbsd[- ](?:2|two)[- ]clause\b(?: licen[sc]e)?
BSD-2-Clause | name | bsd,simplified licen | \b(?:simplified|freebsd) (?:bsd )?licen[sc]e\b
BSD-2-Clause | text | redistributions | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
BSD-3-Clause | name | bsd | \b(?:3|three)[- ]clause bsd(?: licen[sc]e)?\b
BSD-3-Clause | name | bsd | \bbsd[- ](?:3|three)[- ]clause\b(?: licen[sc]e)?
BSD-3-Clause | name | bsd | \b(?:new|revised|modified) bsd licen[sc]e\b
BSD-3-Clause | text | endorse or promote | neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products
BSD-4-Clause | name | bsd | \b(?:4|four)[- ]clause bsd(?: licen[sc]e)?\b
BSD-4-Clause | name | bsd | \bbsd[- ](?:4|four)[- ]clause\b(?: licen[sc]e)?
BSD-4-Clause | name | bsd | \b(?:original|old) bsd licen[sc]e\b
BSD-4-Clause | text | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD | notice | bsd | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?bsd(?:[- ]style)? licen[sc]e\b
BSD | text | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
BSD | name | bsd | \bbsd(?:[- ]style)? licen[sc]e\b
GPL-3.0 | notice | general public licen | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b
GPL-3.0 | notice | general public licen | (?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b
GPL-3.0 | text | general public licen | gnu general public licen[sc]e version 3, 29 june 2007
GPL-3.0 | name | general public licen | (?:gnu )?general public licen[sc]e,? ?\(?(?:version|v\.?)? ?3(?:\.0)?\b\)?
GPL-3.0 | name | gpl | \b(?:gnu )?gpl[- ]?(?:version |v\.?)? ?3(?:\.0)?\b
GPL-3.0-only | name | gpl | \bgpl[- ]?(?:v\.?)?3(?:\.0)?[- ]only\b
GPL-3.0-only | notice | general public licen | general public licen[sc]e,? ?(?:version|v\.?) ?3(?:\.0)? only\b
GPL-3.0-or-later | name | gpl | \bgpl[- ]?(?:v\.?)?3(?:\.0)?(?:\+|[- ]or[- ]later)
GPL-3.0-or-later | notice | either version 3 | general public licen[sc]e as published by the free software foundation[,;] either version 3 of the licen[sc]e,? or \(?at your option\)? any later version
GPL-3.0-or-later | notice | or later,any later,option) later | general public licen[sc]e,? ?(?:version|v\.?) ?3(?:\.0)?,? (?:or (?:\(at your option\) )?(?:any )?later)(?: version)?
GPL-2.0 | notice | general public licen | licen[sc]ed under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
GPL-2.0 | notice | general public licen | (?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
GPL-2.0 | text | general public licen | gnu general public licen[sc]e version 2, june 1991
GPL-2.0 | name | general public licen | (?:gnu )?general public licen[sc]e,? ?\(?(?:version|v\.?)? ?2(?:\.0)?\b\)?
GPL-2.0 | name | gpl | \b(?:gnu )?gpl[- ]?(?:version |v\.?)? ?2(?:\.0)?\b
GPL-2.0-only | name | gpl | \bgpl[- ]?(?:v\.?)?2(?:\.0)?[- ]only\b
GPL-2.0-only | notice | general public licen | general public licen[sc]e,? ?(?:version|v\.?) ?2(?:\.0)? only\b
GPL-2.0-or-later | name | gpl | \bgpl[- ]?(?:v\.?)?2(?:\.0)?(?:\+|[- ]or[- ]later)
GPL-2.0-or-later | notice | either version 2 | general public licen[sc]e as published by the free software foundation[,;] either version 2 of the licen[sc]e,? or \(?at your option\)? any later version
GPL-2.0-or-later | notice | or later,any later,option) later | general public licen[sc]e,? ?(?:version|v\.?) ?2(?:\.0)?,? (?:or (?:\(at your option\) )?(?:any )?later)(?: version)?
GPL-2.0-with-classpath-exception | notice | classpath | (?:gpl(?:v2)?|general public licen[sc]e).{0,60}?classpath exception
GPL-1.0 | text | general public licen | gnu general public licen[sc]e version 1, february 1989
GPL-1.0 | name | general public licen | general public licen[sc]e,? ?(?:version|v\.?) ?1(?:\.0)?\b
GPL | notice | general public licen | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e\b
GPL | notice | gpl | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl\b
GPL | name | general public licen | gnu general public licen[sc]e\b
GPL | name | gpl | \bgnu gpl\b
GPL | hint | gpl | \bgpl\b
LGPL-3.0 | notice | lesser general public | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b
LGPL-3.0 | text | lesser general public | gnu lesser general public licen[sc]e version 3, 29 june 2007
LGPL-3.0 | name | lesser general public | (?:gnu )?lesser general public licen[sc]e,? ?\(?(?:version|v\.?)? ?3(?:\.0)?\b\)?
LGPL-3.0 | name | lgpl | \b(?:gnu )?lgpl[- ]?(?:version |v\.?)? ?3(?:\.0)?\b
LGPL-3.0-or-later | name | lgpl | \blgpl[- ]?(?:v\.?)?3(?:\.0)?(?:\+|[- ]or[- ]later)
LGPL-2.1 | notice | lesser general public | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[sc]e,? ?(?:version|v\.?)? ?2\.1\b
LGPL-2.1 | text | lesser general public | gnu lesser general public licen[sc]e version 2\.1, february 1999
LGPL-2.1 | name | lesser general public | (?:gnu )?lesser general public licen[sc]e,? ?\(?(?:version|v\.?)? ?2\.1\b\)?
LGPL-2.1 | name | lgpl | \b(?:gnu )?lgpl[- ]?(?:version |v\.?)? ?2\.1\b
LGPL-2.1-or-later | notice | either version 2.1 | lesser general public licen[sc]e as published by the free software foundation[,;] either version 2\.1 of the licen[sc]e,? or \(?at your option\)? any later version
LGPL-2.1-or-later | name | lgpl | \blgpl[- ]?(?:v\.?)?2\.1(?:\+|[- ]or[- ]later)
LGPL-2.0 | name | library general public | (?:gnu )?library general public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
LGPL-2.0 | text | library general public | gnu library general public licen[sc]e version 2, june 1991
LGPL | notice | lesser general public | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public licen[sc]e\b
LGPL | name | lesser general public | gnu lesser general public licen[sc]e\b
LGPL | hint | lgpl | \blgpl\b
AGPL-3.0 | notice | affero | (?:released|distributed|licen[sc]ed|available) under (?:the )?(?:terms of (?:the )?)?gnu affero general public licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b
AGPL-3.0 | text | affero | gnu affero general public licen[sc]e version 3, 19 november 2007
AGPL-3.0 | text | remote network interaction | remote network interaction; use with the gnu general public licen[sc]e
AGPL-3.0 | name | affero | (?:gnu )?affero general public licen[sc]e,? ?\(?(?:version|v\.?)? ?3(?:\.0)?\b\)?
AGPL-3.0 | name | agpl | \b(?:gnu )?agpl[- ]?(?:version |v\.?)? ?3(?:\.0)?\b
AGPL-3.0-or-later | name | agpl | \bagpl[- ]?(?:v\.?)?3(?:\.0)?(?:\+|[- ]or[- ]later)
AGPL-3.0-or-later | notice | affero | affero general public licen[sc]e as published by the free software foundation[,;] either version 3 of the licen[sc]e,? or \(?at your option\)? any later version
AGPL-1.0 | name | affero | affero general public licen[sc]e,? ?(?:version|v\.?) ?1(?:\.0)?\b
AGPL | name | affero | (?:gnu )?affero general public licen[sc]e\b
AGPL | hint | agpl | \bagpl\b
GFDL-1.3 | name | free documentation | (?:gnu )?free documentation licen[sc]e,? ?(?:version|v\.?)? ?1\.3\b
GFDL-1.2 | name | free documentation | (?:gnu )?free documentation licen[sc]e,? ?(?:version|v\.?)? ?1\.2\b
GFDL-1.1 | name | free documentation | (?:gnu )?free documentation licen[sc]e,? ?(?:version|v\.?)? ?1\.1\b
GFDL | name | free documentation,gfdl | \b(?:gnu free documentation licen[sc]e|gfdl)\b
GFDL | text | front-cover texts | with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts
MPL-2.0 | notice | mozilla public | (?:subject to the terms of|released under|distributed under|licen[sc]ed under|available under) (?:the )?mozilla public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
MPL-2.0 | text | mozilla.org/mpl/2.0 | obtain one at https?://(?:www\.)?mozilla\.org/mpl/2\.0
MPL-2.0 | name | mozilla public | mozilla public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
MPL-2.0 | name | mpl | \bmpl[- ]?(?:v\.?)? ?2(?:\.0)?\b
MPL-1.1 | notice | mozilla public | contents of this file are subject to the mozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.1\b
MPL-1.1 | name | mozilla public | mozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.1\b
MPL-1.1 | name | mpl | \bmpl[- ]?(?:v\.?)? ?1\.1\b
MPL-1.0 | name | mozilla public | mozilla public licen[sc]e,? ?(?:version|v\.?)? ?1\.0\b
MPL | name | mozilla public | mozilla public licen[sc]e\b
EPL-2.0 | notice | eclipse public | made available under the terms of the eclipse public licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
EPL-2.0 | name | eclipse public | eclipse public licen[sc]e,? ?(?:- )?(?:version|v\.?)? ?2(?:\.0)?\b
EPL-2.0 | name | epl | \bepl[- ]?(?:v\.?)? ?2(?:\.0)?\b
EPL-1.0 | notice | eclipse public | made available under the terms of the eclipse public licen[sc]e,? ?(?:version|v\.?)? ?1(?:\.0)?\b
EPL-1.0 | name | eclipse public | eclipse public licen[sc]e,? ?(?:- )?(?:version|v\.?)? ?1(?:\.0)?\b
EPL-1.0 | name | epl | \bepl[- ]?(?:v\.?)? ?1(?:\.0)?\b
EPL | name | eclipse public | eclipse public licen[sc]e\b
EDL-1.0 | name | eclipse distribution | eclipse distribution licen[sc]e(?:,? ?(?:- )?(?:version|v\.?)? ?1(?:\.0)?)?\b
CDDL-1.0 | name | common development and distribution | common development and distribution licen[sc]e,? ?\(?(?:cddl\)?)? ?(?:version|v\.?)? ?1\.0\b
CDDL-1.1 | name | common development and distribution | common development and distribution licen[sc]e,? ?\(?(?:cddl\)?)? ?(?:version|v\.?)? ?1\.1\b
CDDL | name | common development and distribution,cddl | \b(?:common development and distribution licen[sc]e|cddl)\b
CPL-1.0 | name | common public licen | common public licen[sc]e(?:,? ?(?:- )?(?:version|v\.?)? ?1(?:\.0)?)?\b
IPL-1.0 | name | ibm public licen | ibm public licen[sc]e(?:,? ?(?:version|v\.?)? ?1(?:\.0)?)?\b
EUPL-1.2 | name | european union public,eupl | \b(?:european union public licen[sc]e|eupl),? ?-?(?:version|v\.?)? ?1\.2\b
EUPL-1.1 | name | european union public,eupl | \b(?:european union public licen[sc]e|eupl),? ?-?(?:version|v\.?)? ?1\.1\b
EUPL | name | european union public,eupl | \b(?:european union public licen[sc]e|eupl)\b
CC-BY-4.0 | notice | cc by,cc-by | (?:released|distributed|licen[sc]ed|available|published) under (?:a |the )?(?:creative commons )?cc[- ]by[- ]4\.0\b
CC-BY-4.0 | name | creative commons | creative commons attribution(?: 4\.0)? international(?: \(?cc[- ]by 4\.0\)?)?(?: public)?(?: licen[sc]e)?\b
CC-BY-4.0 | name | cc by,cc-by | \bcc[- ]by[- ]4\.0\b
CC-BY-4.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by/4\.0
CC-BY-3.0 | notice | cc by,cc-by | (?:released|distributed|licen[sc]ed|available|published) under (?:a |the )?(?:creative commons )?cc[- ]by[- ]3\.0\b
CC-BY-3.0 | name | creative commons | creative commons attribution 3\.0(?: unported)?(?: licen[sc]e)?\b
CC-BY-3.0 | name | cc by,cc-by | \bcc[- ]by[- ]3\.0\b
CC-BY-3.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by/3\.0
CC-BY-2.5 | name | cc by,cc-by | \bcc[- ]by[- ]2\.5\b
CC-BY-2.0 | name | cc by,cc-by | \bcc[- ]by[- ]2\.0\b
CC-BY-SA-4.0 | notice | cc by,cc-by | (?:released|distributed|licen[sc]ed|available|published) under (?:a |the )?(?:creative commons )?cc[- ]by[- ]sa[- ]4\.0\b
CC-BY-SA-4.0 | name | creative commons | creative commons attribution[- ]share ?alike 4\.0(?: international)?(?: public)?(?: licen[sc]e)?\b
CC-BY-SA-4.0 | name | cc by,cc-by | \bcc[- ]by[- ]sa[- ]4\.0\b
CC-BY-SA-4.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0 | notice | cc by,cc-by | (?:released|distributed|licen[sc]ed|available|published) under (?:a |the )?(?:creative commons )?cc[- ]by[- ]sa[- ]3\.0\b
CC-BY-SA-3.0 | name | creative commons | creative commons attribution[- ]share ?alike 3\.0(?: unported)?(?: licen[sc]e)?\b
CC-BY-SA-3.0 | name | cc by,cc-by | \bcc[- ]by[- ]sa[- ]3\.0\b
CC-BY-SA-3.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/3\.0
CC-BY-NC-4.0 | notice | cc by,cc-by | (?:released|distributed|licen[sc]ed|available|published) under (?:a |the )?(?:creative commons )?cc[- ]by[- ]nc[- ]4\.0\b
CC-BY-NC-4.0 | name | creative commons | creative commons attribution[- ]non ?-?commercial 4\.0(?: international)?(?: public)?(?: licen[sc]e)?\b
CC-BY-NC-4.0 | name | cc by,cc-by | \bcc[- ]by[- ]nc[- ]4\.0\b
CC-BY-NC-4.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by-nc/4\.0
CC-BY-NC-3.0 | name | cc by,cc-by | \bcc[- ]by[- ]nc[- ]3\.0\b
CC-BY-NC-SA-4.0 | notice | cc by,cc-by | (?:released|distributed|licen[sc]ed|available|published) under (?:a |the )?(?:creative commons )?cc[- ]by[- ]nc[- ]sa[- ]4\.0\b
CC-BY-NC-SA-4.0 | name | creative commons | creative commons attribution[- ]non ?-?commercial[- ]share ?alike 4\.0(?: international)?(?: public)?(?: licen[sc]e)?\b
CC-BY-NC-SA-4.0 | name | cc by,cc-by | \bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
CC-BY-NC-SA-4.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-SA-3.0 | name | cc by,cc-by | \bcc[- ]by[- ]nc[- ]sa[- ]3\.0\b
CC-BY-NC-ND-4.0 | name | creative commons | creative commons attribution[- ]non ?-?commercial[- ]no ?-?derivatives 4\.0(?: international)?(?: public)?(?: licen[sc]e)?\b
CC-BY-NC-ND-4.0 | name | cc by,cc-by | \bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
CC-BY-NC-ND-4.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-NC-ND-3.0 | name | cc by,cc-by | \bcc[- ]by[- ]nc[- ]nd[- ]3\.0\b
CC-BY-ND-4.0 | name | creative commons | creative commons attribution[- ]no ?-?derivatives 4\.0(?: international)?(?: public)?(?: licen[sc]e)?\b
CC-BY-ND-4.0 | name | cc by,cc-by | \bcc[- ]by[- ]nd[- ]4\.0\b
CC-BY-ND-4.0 | tag | creativecommons.org | https?://creativecommons\.org/licenses/by-nd/4\.0
CC0-1.0 | notice | cc0 | (?:released|distributed|licen[sc]ed|available|dedicated) (?:under|with|to) (?:the )?(?:public domain under )?(?:creative commons )?cc0\b(?:[- ]1\.0)?
CC0-1.0 | name | cc0 | \b(?:creative commons )?cc0(?:[- ]1\.0)?(?: universal)?\b
CC0-1.0 | text | waived all copyright | has waived all copyright and related or neighbou?ring rights
CC0-1.0 | tag | creativecommons.org | https?://creativecommons\.org/publicdomain/zero/1\.0
CC-PDDC | tag | creativecommons.org | https?://creativecommons\.org/licenses/publicdomain
PDM-1.0 | tag | creativecommons.org | https?://creativecommons\.org/publicdomain/mark/1\.0
CC | name | creative commons | (?:a )?creative commons licen[sc]e\b
CC | hint | creative commons | \bcreative commons\b
Unlicense | text | unencumbered software | this is free and unencumbered software released into the public domain
Unlicense | name | unlicense | \b(?:the )?unlicense\b
Unlicense | tag | unlicense.org | https?://(?:www\.)?unlicense\.org
public-domain | notice | public domain | (?:released|placed|dedicated|put) (?:in)?to (?:the )?public domain\b
public-domain | notice | public domain | (?:is|are) (?:hereby )?in the public domain\b
public-domain | hint | public domain | \bpublic domain\b
WTFPL | name | what the fuck,wtfpl | \b(?:do what the fuck you want to public licen[sc]e|wtfpl)\b
WTFPL | text | what the fuck | you just do what the fuck you want to
Zlib | name | zlib | \bzlib(?:/libpng)? licen[sc]e\b
Zlib | text | provided 'as-is' | this software is provided 'as-is', without any express or implied warranty\. in no event will the authors be held liable
Zlib | text | altered source versions | altered source versions must be plainly marked as such
Libpng | name | libpng | \blibpng licen[sc]e\b
BSL-1.0 | name | boost software | boost software licen[sc]e(?:,? ?(?:- )?(?:version|v\.?)? ?1\.0)?\b
BSL-1.0 | text | boost | distributed under the boost software licen[sc]e,? ?version 1\.0
BUSL-1.1 | name | business source | business source licen[sc]e(?:,? ?(?:version|v\.?)? ?1\.1)?\b
SSPL-1.0 | name | server side public,sspl | \b(?:server side public licen[sc]e|sspl)(?:,? ?-?(?:version|v\.?)? ?1(?:\.0)?)?\b
Elastic-2.0 | name | elastic licen | elastic licen[sc]e(?:,? ?(?:version|v\.?)? ?2(?:\.0)?)?\b
PolyForm | name | polyform | \bpolyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) licen[sc]e\b
Commons-Clause | name | commons clause | \bcommons clause\b(?: licen[sc]e condition)?
Artistic-2.0 | name | artistic licen | artistic licen[sc]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
Artistic-1.0 | name | artistic licen | artistic licen[sc]e,? ?(?:version|v\.?)? ?1(?:\.0)?\b
Artistic | name | artistic licen | (?:perl )?artistic licen[sc]e\b
Perl | notice | perl itself | under the same terms as perl itself\b
Python-2.0 | name | python software foundation | python software foundation licen[sc]e(?:,? ?(?:version|v\.?)? ?2(?:\.0)?)?\b
PSF-2.0 | name | psf | \bpsf[- ]licen[sc]e(?: agreement)?\b
PHP-3.01 | name | php licen | \bphp licen[sc]e,? ?(?:version|v\.?)? ?3\.01\b
PHP-3.0 | name | php licen | \bphp licen[sc]e(?:,? ?(?:version|v\.?)? ?3\.0)?\b
Ruby | name | ruby licen,ruby's licen | \bruby(?:'s)? licen[sc]e\b
Ruby | notice | terms as ruby | under the same terms as ruby(?: itself)?\b
PostgreSQL | name | postgresql licen | \bpostgresql licen[sc]e\b
OpenSSL | name | openssl licen | \bopenssl licen[sc]e\b
OpenSSL | text | openssl project | this product includes software developed by the openssl project
SSLeay | text | eric young | this product includes cryptographic software written by eric young
curl | name | curl licen | \bcurl licen[sc]e\b
NCSA | name | ncsa,university of illinois | \b(?:university of illinois/ncsa|ncsa) open source licen[sc]e\b
OFL-1.1 | name | open font licen | (?:sil )?open font licen[sc]e,? ?(?:version|v\.?)? ?1\.1\b
OFL-1.0 | name | open font licen | (?:sil )?open font licen[sc]e,? ?(?:version|v\.?)? ?1\.0\b
OFL | name | open font licen | (?:sil )?open font licen[sc]e\b
OFL-1.1 | tag | scripts.sil.org/ofl | https?://scripts\.sil\.org/ofl
LPPL-1.3c | name | latex project public,lppl | \b(?:latex project public licen[sc]e|lppl),? ?-?(?:version|v\.?)? ?1\.3c?\b
LPPL | name | latex project public,lppl | \b(?:latex project public licen[sc]e|lppl)\b
MS-PL | name | microsoft public licen,ms-pl | \b(?:microsoft public licen[sc]e|ms-pl)\b
MS-RL | name | microsoft reciprocal,ms-rl | \b(?:microsoft reciprocal licen[sc]e|ms-rl)\b
OSL-3.0 | name | open software licen | open software licen[sc]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b
AFL-3.0 | name | academic free licen | academic free licen[sc]e(?:,? ?(?:version|v\.?)? ?3(?:\.0)?)?\b
ECL-2.0 | name | educational community | educational community licen[sc]e(?:,? ?(?:version|v\.?)? ?2(?:\.0)?)?\b
APSL-2.0 | name | apple public source | apple public source licen[sc]e(?:,? ?(?:version|v\.?)? ?2(?:\.0)?)?\b
NPL-1.1 | name | netscape public | netscape public licen[sc]e(?:,? ?(?:version|v\.?)? ?1\.[01])?\b
QPL-1.0 | name | q public licen | \bq public licen[sc]e(?:,? ?(?:version|v\.?)? ?1\.0)?\b
Sleepycat | name | sleepycat | \bsleepycat(?: public)? licen[sc]e\b
SPL-1.0 | name | sun public licen | sun public licen[sc]e(?:,? ?(?:version|v\.?)? ?1\.0)?\b
W3C | name | w3c | \bw3c(?:\(r\)|®)? (?:software(?: notice)?(?: and document)?) (?:notice and )?licen[sc]e\b
Vim | name | vim licen | \bvim licen[sc]e\b
ZPL-2.1 | name | zope public | zope public licen[sc]e(?:,? ?\(?(?:zpl\)?)? ?(?:version|v\.?)? ?2\.[01])?\b
UPL-1.0 | name | universal permissive | universal permissive licen[sc]e(?:,? ?\(?(?:upl\)?)? ?(?:version|v\.?)? ?1\.0)?\b
MulanPSL-2.0 | name | mulan | \bmulan psl ?v?2\b
MulanPSL-2.0 | name | mulan permissive | mulan permissive software licen[sc]e,? ?(?:version|v\.?)? ?2\b
BlueOak-1.0.0 | name | blue oak | blue oak model licen[sc]e(?: 1\.0\.0)?\b
CECILL-2.1 | name | cecill | \bcecill(?:-| )?(?:v|version )?2\.1\b
CECILL-B | name | cecill | \bcecill-b\b
CECILL-C | name | cecill | \bcecill-c\b
CECILL | hint | cecill | \bcecill\b
ODbL-1.0 | name | database licen,odbl | \b(?:open (?:data commons )?(?:open )?database licen[sc]e|odbl)(?:,? ?-?(?:version|v\.?)? ?1\.0)?\b
ODC-By-1.0 | name | open data commons attribution,odc-by | \b(?:open data commons attribution licen[sc]e|odc-by)(?:,? ?-?(?:version|v\.?)? ?1\.0)?\b
PDDL-1.0 | name | public domain dedication,pddl | \b(?:open data commons public domain dedication(?: and| &)? licen[sc]e|pddl)(?:,? ?-?(?:version|v\.?)? ?1\.0)?\b
OGL-UK-3.0 | name | open government licen | open government licen[sc]e(?:,? ?(?:version|v\.?)? ?3(?:\.0)?)?\b
Etalab-2.0 | name | licence ouverte | licence ouverte(?: / open licen[sc]e)?(?:,? ?(?:version|v\.?)? ?2\.0)?\b
OpenRAIL-M | name | openrail,open rail | \b(?:creativeml |bigcode |bigscience )?open ?rail(?:\+\+)?(?:-m)?(?: licen[sc]e)?\b
Llama | name | llama | \bllama ?[23](?:\.\d)? community licen[sc]e\b
Gemma | name | gemma terms | \bgemma terms of use\b
HPND | text | permission to use | permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
Beerware | name | beer-ware,beerware | \b(?:the )?beer-?ware licen[sc]e\b
Beerware | text | buy me a beer | you can buy me a beer in return
JSON | text | be used for good | the software shall be used for good, not evil
FTL | name | freetype | \bfreetype(?: project)? licen[sc]e\b
IJG | text | independent jpeg group | this software is based in part on the work of the independent jpeg group
ICU | name | icu licen | \bicu licen[sc]e\b
Unicode | name | unicode | \bunicode(?:,? inc\.?)? licen[sc]e(?: agreement)?\b
NTP | name | ntp licen | \bntp licen[sc]e\b
TCL | name | tcl/tk licen | \btcl/tk licen[sc]e\b
Intel | name | intel open source,intel simplified | \bintel (?:open source|simplified software) licen[sc]e\b
Naver | name | naver | \bnaver open source licen[sc]e\b
proprietary | notice | all rights reserved | \ball rights reserved\b
proprietary | notice | confidential | (?:proprietary and confidential|confidential and proprietary)\b
proprietary | notice | unauthorized copying,unauthorised copying | unauthori[sz]ed copying of this (?:file|software|document),? via any medium,? is strictly prohibited
proprietary | notice | commercial licen | (?:released|distributed|licen[sc]ed|available) under (?:a |the )?commercial licen[sc]e\b
proprietary | name | end user licen,end-user licen,eula | \b(?:end[- ]user licen[sc]e agreement|eula)\b
non-commercial | notice | non-commercial,noncommercial | (?:for )?non-?commercial use only\b
research-only | notice | research | for (?:academic )?research (?:purposes|use) only\b
any | tag | spdx-licen | spdx-license-identifier ?: ?\(?[a-z0-9][a-z0-9.+-]*(?: (?:or|and|with) [a-z0-9][a-z0-9.+-]*)*\)?
any | hint | licen | \b(?:see|read) (?:the )?(?:accompanying )?licen[sc]e(?:\.txt|\.md)?(?: file)?(?: for)? (?:details|more information|the full text)\b
any | hint | licen | \blicen[sc]ed under\b
any | hint | copyright | \bcopyright (?:\(c\)|©)? ?(?:\d{4})(?:[-, ]+\d{4})*\b
any | hint | © | © ?(?:\d{4})(?:[-, ]+\d{4})*\b
"""
