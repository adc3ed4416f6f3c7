"""The notices by which licences are known: words of their texts and of the headers that they ask for."""

from __future__ import annotations

#: Fixed values: (label, notice, the phrases of which one must stand in place).
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("hereby granted free of charge to any person obtaining a copy",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included in all copies or substantial portions",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("and or distribute this software for any purpose with or without fee",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed under the license is distributed on an as is basis",)),
    ("gpl", "licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("under the terms of the gnu general public license as published by the free software foundation either version 2",)),
    ("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("under the terms of the gnu general public license as published by the free software foundation either version 3",)),
    ("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license",)),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", ("gnu lesser general public license version 2 1",)),
    ("lgpl-3", "gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-2", "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is", ("materials provided with the distribution this software is provided by",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("names of its contributors may be used to endorse or promote products derived from this software",)),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("this source code form is subject to the terms of the mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("has waived all copyright and related or neighboring rights",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under cc by 3 0", ("cc by 3 0",)),
    ("cc-by", "licensed under cc by 2 0", ("cc by 2 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    ("bsl", "boost software license version 1 0", ("boost software license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising from the use of this software",)),
)
