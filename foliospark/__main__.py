from foliospark.api import main

raise SystemExit(main())
