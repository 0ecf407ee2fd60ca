from tracefuse.cli import main

main()
